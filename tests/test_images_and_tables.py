from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.operators import facts, images, index, structocr, tableocr
from lodestone.operators.chunking import chunk_pages
from lodestone.plans import catalog, fixtures, runs
from lodestone.sources import adapters, tables
from lodestone.streaming.ingest import start_ingest


def boxes(spark):
    return fixtures.box_frame(spark)


def recognised(spark):
    return structocr.validate(fixtures.prediction_frame(spark))


def report(spark):
    return spark.createDataFrame(fixtures.TABLE_REPORT, catalog.REPORT)


def test_decisions_on_word_boxes(spark):
    wanted = spark.createDataFrame([(t,) for t in ("faint", "list", "empty", "two_by_two", "ticks", "titled", "gaps")], "table_id string")
    got = {r.table_id: r for r in tableocr.decide(wanted, boxes(spark)).collect()}
    assert {k: (v.status, v.reason) for k, v in got.items()} == {
        "faint": ("refused", "low_confidence"), "list": ("refused", "grid_not_recovered"), "empty": ("refused", "no_text"), "two_by_two": ("accepted", None), "ticks": ("refused", "grid_not_recovered"),
        "titled": ("accepted", None), "gaps": ("refused", "sparse_grid"),
    }
    assert got["two_by_two"].cells == [["salt", "mass"], ["NaCl", "58.4"]] and got["faint"].cells is None and got["empty"].raw_text == ""
    titled = got["titled"]
    assert (titled.n_rows, titled.n_cols, titled.spanning_rows) == (6, 3, [0])
    assert titled.cells[0][0] == "Melting points of all salts seen here" and titled.cells[1] == ["Salt", "Point", "Note"] and titled.cells[2] == ["r0c0", "r0c1", "r0c2"]


def test_skip_reasons_records_and_summary(spark):
    rows = [("A.pdf", 1, 0, "table_image", 1601, 5), ("A.pdf", 1, 1, "structure_drawing", 800, 800), ("A.pdf", 1, 2, "table_image", 1588, 677), ("A.pdf", 1, 3, "table_image", 80, 20), ("A.pdf", 2, 0, "table_image", 300, 200)]
    inventory = spark.createDataFrame(rows, "filename string, page int, image_index int, label string, width int, height int")
    ids = {r.image_index: r.id for r in inventory.where("page = 1").select("image_index", tableocr.table_id(F.col("filename"), F.col("page"), F.col("image_index")).alias("id")).collect()}
    words = boxes(spark).where("table_id = 'two_by_two'").withColumn("table_id", F.lit(ids[2]))
    failures = inventory.where("page = 2").select(tableocr.table_id(F.col("filename"), F.col("page"), F.col("image_index")).alias("table_id"), F.lit("ocr_error:OSError").alias("error"))
    records = tableocr.table_records(inventory, words, failures)
    assert sorted((r.page, r.image_index, r.status, r.reason) for r in records.collect()) == [(1, 0, "skipped", "thin_table_rule"), (1, 2, "accepted", None), (1, 3, "skipped", "not_table_like"), (2, 0, "refused", "ocr_error:OSError")]
    counts = {(r.status, r.reason): r.n_tables for r in tableocr.table_summary(records).where("level = 0").collect()}
    assert counts[("skipped", "thin_table_rule")] == 1 and len(counts) == 4


def test_ocr_words_and_adapter(spark):
    data = {"level": ["5", 5, 5, 5], "conf": ["90", -1, "x", 80.5], "text": ["a", "b", "c", " d "], "left": [1, 2, 3, 4], "top": [1, 1, 1, 1], "width": [5, 5, 5, 5], "height": [6, 6, 6, 6]}

    def read(content):
        if content == b"bad":
            raise OSError
        return data

    images_ = spark.createDataFrame([("t", bytearray(b"x")), ("u", bytearray(b"bad"))], "table_id string, content binary")
    raw = adapters.ocr_words(images_, read)
    assert {r.table_id: r.error for r in raw.collect()} == {"t": None, "u": "ocr_error:OSError"}
    assert sorted((r.table_id, r.text, r.conf, r.left) for r in tableocr.words_from_columns(raw).collect()) == [("t", "a", 90.0, 1), ("t", "d", 80.5, 4)]


def test_table_text_keeps_places(spark):
    rows = spark.createDataFrame([([["acetaminophen", "", "HPLC"]], []), ([["caption", "", ""], ["a", "b", ""]], [0])], "c array<array<string>>, s array<int>")
    assert [r.t for r in rows.select(tableocr.table_text(F.col("c"), F.col("s")).alias("t")).collect()] == ["acetaminophen |  | HPLC", "caption\na | b |"]


def test_thin_rules_and_classes(spark):
    got = {(r.filename, r.page, r.image_index): (r.label, r.reasons) for r in images.classify(fixtures.image_frame(spark)).collect()}
    assert got[("A_first.pdf", 1, 0)] == ("table_image", ["thin_wide_strip"]) and got[("notes.pdf", 1, 0)] == ("table_image", ["thin_tall_strip"])
    assert got[("B_second.pdf", 2, 0)] == ("unknown", ["missing_dimensions"]) and got[("A_first.pdf", 3, 0)] == ("structure_drawing", ["near_square", "sparse_line_art"])
    assert got[("A_first.pdf", 2, 0)] == ("table_image", ["wide_aspect", "grid_like", "horizontal_lines"]) and got[("notes.pdf", 1, 1)] == ("other", ["dense_or_photo"])
    with pytest.raises(ValueError, match="byte_size"):
        images.check_inventory(spark.createDataFrame([("A", "f")], "paper_id string, filename string"))


def test_pixel_features(spark):
    rows = {r.image: r for r in images.pixel_features(spark.createDataFrame(fixtures.pixels(), "image string, y int, x int, v int")).collect()}
    assert rows["lines"].grid and rows["lines"].n_hlines == 8 and not rows["tone"].grid and rows["tone"].ink_frac == 1.0 and rows["tone"].entropy == 0.0
    colours = spark.createDataFrame([("i", 30, 90, 160)], "image string, r int, g int, b int")
    assert images.chroma(colours).first().chroma == 65.0


def test_structures_are_validated_and_kept_once(spark):
    rows = recognised(spark)
    got = {r.id: (r.status, r.reason, r.confidence) for r in rows.collect()}
    assert got["ocsr_1"] == ("accepted", None, 0.91) and got["ocsr_3"][:2] == ("refused", "invalid_smiles") and got["ocsr_7"][:2] == ("refused", "recognizer_error:RuntimeError")
    assert got["ocsr_4"][:2] == ("refused", "empty_prediction") and got["ocsr_6"][:2] == ("refused", "too_small")
    assert {r.id for r in structocr.deduplicate(rows).collect()} == set(got) - {"ocsr_2"}
    assert structocr.for_block(rows, None).count() == 0

    def recognise(content):
        if content == b"!":
            raise RuntimeError
        return {"smiles": " CCO ", "confidence": "0.5"}

    crops = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"!"))], "crop_id string, content binary")
    assert sorted((r.crop_id, r.predicted_smiles, r.confidence, r.error) for r in adapters.recognised(crops, recognise).collect()) == [("a", "CCO", 0.5, None), ("b", None, None, "RuntimeError")]
    answers = [" C ", ("C", "x"), ["C", 1], {}, None, {"SMILES": "O", "confidence": 2}, ("N",), 7]
    crops = spark.createDataFrame([(str(i), bytearray(str(i).encode())) for i in range(len(answers))], "crop_id string, content binary")
    got = {r.crop_id: (r.predicted_smiles, r.confidence) for r in adapters.recognised(crops, lambda content: answers[int(content)]).collect()}
    assert [got[str(i)] for i in range(len(answers))] == [("C", None), ("C", None), ("C", 1.0), ("", None), ("", None), ("O", 2.0), ("N", None), ("7", None)]


def test_attaching_is_idempotent(spark):
    pages = spark.createDataFrame([(0, "A.pdf", 1, "plain")], "page_ord long, source_doc string, page_number long, text string")
    empty = F.array().cast("array<string>")
    chunks = chunk_pages(pages).withColumn("compounds", empty).withColumn("blocks", empty)
    records = structocr.deduplicate(recognised(spark))
    once = index.attach_structures(chunks, records)
    twice = index.attach_structures(once, records)
    assert once.count() == twice.count() == 3
    anchor = twice.where("extraction_method = 'structure_ocr'").orderBy("source_doc").first()
    assert anchor.blocks == [catalog.BLOCK] and anchor.image_structure_ids == ["ocsr_1"] and anchor.text == C.STRUCTURE_PASSAGE
    lexicon = spark.createDataFrame([("acetaminophen", fixtures.SUBJECT)], "name string, smiles string")
    none = spark.createDataFrame([], "name string, smiles string, inchikey string, block string")
    first, known = index.attach_tables(twice, none, report(spark), lexicon)
    again, _ = index.attach_tables(first, known, report(spark), lexicon)
    tables_ = again.where("extraction_method = 'table_ocr'").orderBy("source_doc").collect()
    assert first.count() == again.count() == 5 and "acetaminophen | 50" in tables_[0].text and tables_[0].compounds == ["acetaminophen"] and tables_[0].blocks == [catalog.BLOCK]
    assert index.ocr_candidates(report(spark)).count() == 3
    # records of several pages that are numbered alike still have keys of their own
    alike = index.attach_structures(chunks, records.withColumn("ord", F.lit(1)))
    assert alike.select("chunk_ord").distinct().count() == alike.count() == 3
    assert [r.p for r in first.orderBy("chunk_ord").select(F.col("chunk_ord.part").alias("p")).collect()] == [0, 1, 1, 2, 2]


def test_inventory_is_loaded_or_built(spark, tmp_path):
    def build():
        calls.append(1)
        return spark.createDataFrame([("A", "f.pdf", 1, 0, 5, 5, 9, "other", "heuristic")], "paper_id string, filename string, page int, image_index int, width int, height int, byte_size int, label string, confidence string")

    calls = []
    for _ in range(2):
        assert runs.inventory_at(spark, str(tmp_path / "inventory"), build).count() == 1
    assert calls == [1]
    tables.write_report_json(build(), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first().filename == "f.pdf"


def test_decoders_in_turn_and_kept_crops(spark, tmp_path):
    def fails(content):
        raise ValueError

    images_ = spark.createDataFrame([("a", bytearray(b"\x05\x09"))], "image string, content binary")
    read = adapters.first_that_reads(fails, lambda content: [(0, i, v) for i, v in enumerate(content)])
    assert [(r.y, r.x, r.v) for r in adapters.rasters(images_, read).orderBy("x").collect()] == [(0, 0, 5), (0, 1, 9)]
    with pytest.raises(ValueError, match="^$"):
        adapters.first_that_reads(fails, fails)(b"")
    crops = spark.createDataFrame([("c1", bytearray(b"x")), ("c2", None)], "id string, content binary")
    kept = {r.id: r.image_path for r in tables.keep_crops(crops, str(tmp_path / "crops")).collect()}
    assert kept == {"c1": f"{tmp_path}/crops#c1", "c2": None} and spark.read.parquet(str(tmp_path / "crops")).count() == 1


def test_fixed_values_are_those_of_the_survey():
    """Limits and patterns that code and SQL share, against the figures as they must be."""
    assert (C.CHUNK_WORDS, C.OVERLAP_WORDS, C.TOP_K, C.CHAT_TOP_K, C.MAX_CANDIDATES, C.MAX_TABLE_NAMES, C.MIN_HEAVY_ATOMS) == (180, 40, 4, 6, 500, 25, 3)
    assert (C.BM25_K1, C.BM25_B, C.HISTORY_TURNS, C.FOLLOW_UPS, C.FOLLOW_UP_CHARACTERS) == (1.5, 0.75, 6, 3, 180)
    assert (C.OCR_CONFIDENCE, C.OCR_MIN_ROWS, C.OCR_MIN_COLS, C.OCR_MIN_FILL, C.OCR_MIN_WIDTH, C.OCR_MIN_HEIGHT, C.OCR_WORD_LEVEL) == (70.0, 2, 2, 0.4, 120, 40, 5)
    assert (C.STRIP_THICKNESS, C.STRIP_ASPECT, C.GUTTER_SCALE, C.MERGE_SCALE, C.ROW_SCALE, C.SUPPORT_FLOOR) == (16, 8.0, 1.5, 1.0, 0.7, 2)
    assert (len(C.SUFFIXES), len(C.MORPHEMES), C.MIN_WORD, C.MIN_MORPHEME_WORD, C.MIN_MORPHEMES, C.MIN_ACID_STEM) == (23, 29, 5, 8, 2, 4)


def test_solubility_facts(spark, tmp_path):
    rows = catalog.fact_rows(spark)
    assert {r.solvent: r.n for r in rows.groupBy("solvent").agg(F.count("*").alias("n")).collect()} == {"DMSO": 24, "DMF": 20}
    first = rows.where("solvent = 'DMSO'").orderBy("row_ord", "temperature_C").first()
    assert (first.organic_fraction, first.temperature_C, first.solubility_x100, first.source) == (0.0, 25, 2.7, 2) and abs(first.upper - 2.71) < 1e-9
    assert {r.solvent: len(r.points) for r in facts.chart_series(rows, False).where("series = 0.2").collect()} == {"DMSO": 4, "DMF": 4}
    tables.write_facts_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 44
    page = fixtures.fact_page().replace("25 ◦C", "26 ◦C", 1)
    altered = spark.createDataFrame([(1, C.FACT_DOCUMENT, C.FACT_PAGE, ["K"], page)], "rank int, source_doc string, page_number long, blocks array<string>, text string")
    assert facts.solubility_rows(altered, "K", {"K": ("A", "x")}).count() == 0
    assert facts.solubility_rows(altered, "J", {"K": ("A", "x")}).count() == 0


def test_pdf_adapter_and_lookup(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"one|two")
    files = adapters.pdf_files(spark, str(tmp_path))
    pages = adapters.pdf_pages(files, lambda content: content.decode().split("|")).orderBy("source_doc", "page_number").collect()
    assert [(p.source_doc, p.page_number, p.text) for p in pages] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("b.pdf", 1, "one"), ("b.pdf", 2, "two")]
    assert [p.page_ord.page for p in sorted(pages, key=lambda p: p.page_ord)] == [1, 2, 1, 2]
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert {(r.name, r.smiles) for r in adapters.look_up(names, {"x": "C"}.get).collect()} == {("x", "C"), ("y", None)}
    often = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3)], "name string, frequency long")
    assert {r.name for r in adapters.look_up(often, {}.get, most=2).collect()} == {"b", "c"}
    assert adapters.version_of("pyspark") and adapters.version_of("no_such_module") is None
    assert adapters.available("json") and not adapters.available("no_such_module")


def test_streaming_ingest(spark, tmp_path):
    pages = spark.createDataFrame([(0, "A.pdf", 1, "paracetamol " * 200), (1, "A.pdf", 2, "caffeine")], "page_ord long, source_doc string, page_number long, text string")
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 3
    assert {r.name for r in spark.read.parquet(str(tmp_path / "out/names")).collect()} == {"paracetamol", "caffeine"}


def test_whole_runs(spark, tmp_path):
    (tmp_path / "A_x.pdf").write_bytes(b"file")
    files = adapters.pdf_files(spark, str(tmp_path))
    embedded = adapters.pdf_images(files, lambda content: [(1, 0, 1601, 5, 10, "/a", ["/F"], b"strip"), (1, 1, 300, 300, 10, "/b", None, b"good"), (2, 0, 300, 290, 10, "/c", None, b"bad")])
    found = runs.inventory(embedded)
    assert {(r.image_index, r.page): (r.label, r.paper_id) for r in found.collect()} == {(0, 1): ("table_image", "A"), (1, 1): ("structure_drawing", "A"), (0, 2): ("structure_drawing", "A")}

    def recognise(content):
        if content.startswith(b"bad"):
            raise ValueError
        return "CC(=O)Nc1ccc(O)cc1"

    records = runs.run_structure_ocr(found, adapters.page_images(files, lambda content, dpi: [b"page", b"page"]), lambda image: [image, image], recognise).collect()
    assert sorted((r.page_number, r.source_kind, r.status) for r in records) == [(1, "embedded", "accepted"), (2, "embedded", "refused"), (2, "embedded", "refused"), (2, "page_segment", "accepted")]
    assert all(r.id.startswith("ocsr_") for r in records)
    with pytest.raises(ValueError, match="neither"):
        runs.run_structure_ocr(None, None, lambda image: [], recognise)
    tables_ = found.withColumn("label", F.lit("table_image")).withColumn("content", F.expr("if(page = 2, null, content)"))
    words = {"level": [5] * 4, "conf": [90] * 4, "text": ["A", "B", "1", "2"], "left": [10, 120, 10, 120], "top": [10, 10, 50, 50], "width": [40] * 4, "height": [16] * 4}
    got = sorted((r.page, r.image_index, r.status, r.reason) for r in runs.run_table_ocr(tables_, lambda content: words).collect())
    assert got == [(1, 0, "skipped", "thin_table_rule"), (1, 1, "accepted", None), (2, 0, "refused", "decode_failed")]


def test_all_names_of_a_table_are_looked_up(spark):
    """A name behind 25 others of its table has its key; a caller may still ask for the first alone."""
    cells = [[f"{c}aqine" for c in "abcdefghijklmnopqrstuvwxyz"], ["zcaffeine"] + [""] * 25]
    told = spark.createDataFrame([(0, "t", "A.pdf", 1, "accepted", None, 90.0, cells, [])], catalog.REPORT)
    pages = spark.createDataFrame([(0, "A.pdf", 1, "plain")], "page_ord long, source_doc string, page_number long, text string")
    empty = F.array().cast("array<string>")
    chunks = chunk_pages(pages).withColumn("compounds", empty).withColumn("blocks", empty)
    lexicon = spark.createDataFrame([("zcaffeine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O")], "name string, smiles string")
    none = spark.createDataFrame([], "name string, smiles string, inchikey string, block string")
    for most, wanted in ((None, ["zcaffeine"]), (C.MAX_TABLE_NAMES, [])):
        found, known = index.attach_tables(chunks, none, told, lexicon, **({} if most is None else {"max_names": most}))
        assert found.where("extraction_method = 'table_ocr'").first().compounds == [r.name for r in known.collect()] == wanted


def test_tables_are_searched_once_for_names(spark, tmp_path):
    told = spark.createDataFrame([(0, "t", "A.pdf", 1, "accepted", None, 90.0, [["ca ffeine", "caffeine"], ["unknownine", ""]], [])], catalog.REPORT)
    pages = spark.createDataFrame([(0, "A.pdf", 1, "plain")], "page_ord long, source_doc string, page_number long, text string")
    empty = F.array().cast("array<string>")
    chunks = chunk_pages(pages).withColumn("compounds", empty).withColumn("blocks", empty)
    lexicon = spark.createDataFrame([("caffeine", "Cn1c(=O)c2c(ncn2C)n(C)c1=O")], "name string, smiles string")
    none = spark.createDataFrame([], "name string, smiles string, inchikey string, block string")
    found, known = index.attach_tables(chunks, none, told, lexicon, folder=str(tmp_path / "names"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "names")).collect()] == [("t", "caffeine")]
    assert "MapInArrow" not in known._jdf.queryExecution().executedPlan().toString() and [r.name for r in known.collect()] == ["caffeine"]
    assert found.where("table_ocr_id = 't'").first().compounds == ["caffeine"]
