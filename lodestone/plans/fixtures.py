"""Input tables for queries that no corpus table fits.

Small tables of chosen cases are given once and turned into a DataFrame or into SQL. Beside them stand tables that follow
the corpus in size: one row or more for each document or turn, made by arithmetic on ids and from the texts. Their
statements are the same for both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.names import NameRules
from lodestone.functions.text import words

#: Frequent words of the corpus as spellings of a few structures; one name is in no text, one has too few atoms, two
#: differ in stereochemistry only, and four are words that a blank may part.
LEXICON = [
    ("thble", "CC(=O)Nc1ccc(O)cc1"), ("thtion", "CC(=O)Nc1ccc(O)cc1"), ("thing", "CC(=O)Nc1ccc(O)cc1"), ("ofthe", "CC(=O)Nc1ccc(O)cc1"),
    ("attion", "CCOc1ccc(NC(C)=O)cc1"), ("erble", "CCOc1ccc(NC(C)=O)cc1"), ("andthe", "CCOc1ccc(NC(C)=O)cc1"),
    ("ertion", "Cn1c(=O)c2c(ncn2C)n(C)c1=O"), ("ering", "O=C(O)/C=C/C(=O)O"), ("oning", "O=C(O)/C=C\\C(=O)O"), ("dela", "CC(=O)Nc1ccccc1.Cl"),
    ("antion", "O"), ("carbamazepine", "NC(=O)N1c2ccccc2C=Cc2ccccc21"),
]
#: Names looked up before; a null says that the name is no compound.
CACHE = [("ontion", "CC(C)Cc1ccc(C(C)C(=O)O)cc1"), ("retion", None), ("thble", "C")]
RULES = NameRules(suffixes=("ion", "ble", "ing", "eit"))
MAX_CANDIDATES = 500
SUBJECT = "CC(=O)Nc1ccc(O)cc1"
#: The block of SUBJECT, as ``structure_keys`` gives it.
SUBJECT_BLOCK = "21B3B39E25E000"
QUESTION = "queque des mentla pour thon than und der erin thth"
EXTRA_NAME = "thre"
NAME_TEXTS = [
    (1, "Ibuprofen-Citric Acid was mixed with nicotinic acid and sorbic acid"), (2, "Acid-Ibuprofen and ibuprofen-like tablets"), (3, "menthol-rich and men thol"),
    (4, "the registry number 58-08-2 stands for it"), (5, "n-butylpropanamide or 3-methoxyaniline"), (6, "pseudoibuprofen-unlisted"), (7, "a long-lived common saying"),
    (8, "acetaminophen, phenacetin, water, determine and hydrochlorothiazide"), (9, "nitrophenols and chlorobenzoates of the membrane"),
]
VOCABULARY = ["ibuprofen", "menthol", "phenacetin", "citric acid", "58-08-2", "3-methoxyaniline"]
HYPHEN_TEXTS = [(1, "parace-\ntamol"), (2, "co-crystal"), (3, "caf- \n feine and well-\nknown"), (4, "1‑2–3 ‐x‒y"), (5, "end -\n start")]
REFERENCE_TEXTS = [
    (1, "12. Smith, A. text [CrossRef] 13. Jones, B. more [PubMed] 14. Brown, C. doi"), (2, "Plain prose with one doi in it."), (3, "Lee, K.; Wu, J.; Kim, S.; Ito, T.; Roy, P.; Das, M.; see https://doi.org for all"),
    (4, "1. Adams, B. 2. Clark, D. 3. Evans, F. and others"), (5, "A.; B.; C.; D.; E.; F.; G.; without a marker"),
]
ANSWERS = [
    (1, 'It dissolves. <followups>["In what?", "In what?"]</followups>'), (2, "It melts. <followups>at once</followups>"), (3, "  No tag here  "), (4, 'Body\n<followups>["a", 3, "", " b ", "c", "d"]</followups> rest'),
    (5, 'Text <followups>["' + "x" * 181 + '", "ok"]</followups>'), (6, 'Text <followups>{"a": "b"}</followups>'), (7, "Text <followups>[]</followups>"), (8, 'Open <followups>["one"]'),
]
IMAGES = [
    ("A_first.pdf", 1, 0, 1601, 5), ("A_first.pdf", 1, 1, 1601, 3), ("A_first.pdf", 2, 0, 1588, 677), ("A_first.pdf", 3, 0, 400, 300), ("B_second.pdf", 1, 0, 900, 300), ("B_second.pdf", 1, 1, 800, 500),
    ("B_second.pdf", 2, 0, None, None), ("notes.pdf", 1, 0, 4, 900), ("notes.pdf", 1, 1, 300, 200), ("notes.pdf", 2, 0, 800, 800), ("notes.pdf", 2, 1, 80, 20),
]
#: (filename, page, image_index): white_frac, ink_frac, chroma, n_hlines, grid
FEATURES = {
    ("A_first.pdf", 2, 0): (0.8, 0.1, 3.0, 8, True), ("A_first.pdf", 3, 0): (0.9, 0.05, 1.0, 0, False), ("B_second.pdf", 1, 0): (0.5, 0.2, 40.0, 1, False), ("B_second.pdf", 1, 1): (0.7, 0.3, 2.0, 2, True),
    ("notes.pdf", 1, 1): (0.1, 0.8, 60.0, 0, False),
}
FILES = ["A_melting_points.pdf", "remarks.pdf", "_x.pdf", "dir/B_c_d.pdf", "plain"]
TABLE_IMAGES = [("table_image", 1601, 5), ("structure_drawing", 800, 800), ("table_image", 1588, 677), ("table_image", 80, 20), ("table_image", None, 100)]


def pixels() -> list[tuple[str, int, int, int]]:
    """Small rasters: ruled lines, a cross, and one tone."""
    lines = [("lines", y, x, 0 if y % 8 < 2 and y >= 8 else 255) for y in range(40) for x in range(24)]
    cross = [("cross", y, x, 20 if x == y or x == 19 - y else 250) for y in range(20) for x in range(20)]
    return lines + cross + [("tone", y, x, 120) for y in range(6) for x in range(8)]


def word_boxes() -> list[tuple[str, int, str, float, int, int, int, int]]:
    """OCR words of seven cases: (table, ord, text, conf, left, top, width, height)."""
    grid = [(f"r{r}c{c}", 93, 10 + 130 * c, 90 + 36 * r) for r in range(4) for c in range(3)]
    cases: dict[str, list[tuple]] = {
        "faint": [(str(n), 31 + n, 15 + 90 * (n % 2), 12 + 30 * (n // 2)) for n in range(6)],
        "list": [(w, 89, 12 + n % 2, 15 + 32 * n) for n, w in enumerate(("iron", "zinc", "lead", "gold"))],
        "two_by_two": [("salt", 90, 12, 12), ("mass", 94, 125, 12), ("NaCl", 87, 12, 52), ("58.4", 92, 125, 52)],
        "ticks": [(str(5 * i), 91, 20 + 85 * i, 10) for i in range(9)] + [("y", 90, 20, y) for y in (55, 95, 140)],
        "titled": [(w, 92, 10 + 43 * i, 14) for i, w in enumerate("Melting points of all salts seen here".split())] + [("Salt", 92, 10, 52), ("Point", 92, 140, 52), ("Note", 92, 270, 52)] + grid,
        "gaps": [(f"g{c}", 92, 95 * c, 38 * r) for r in range(10) for c in range(18)] + [("z", 92, 0, 380 + 38 * r) for r in range(19)],
    }
    return [(case, i, text, float(conf), left, top, 40, 16) for case, words in cases.items() for i, (text, conf, left, top) in enumerate(words)]


#: A number below a million that goes with a document.
D = "(doc_id % 1000003)"

#: Two images for each document: every size and class, some without dimensions or pixels.
IMAGES_OF_DOCUMENTS = f"""
select coalesce(source, 'none') || '_' || cast({D} % 5 as string) || '.pdf' as filename, cast(doc_id % 1000 as int) as page, cast(floor({D} / 1000) as int) as image_index,
  case when {D} % 17 = 0 then null else cast(4 + ({D} * 7919) % 1600 as int) end as width, case when {D} % 19 = 0 then 0 else cast(3 + ({D} * 104729) % 900 as int) end as height,
  {D} % 3 <> 0 as decoded, cast(({D} * 31) % 101 as double) / 100 as white_frac, cast(({D} * 17) % 71 as double) / 100 as ink_frac, cast(({D} * 7) % 60 as double) as chroma, cast({D} % 11 as int) as n_hlines, {D} % 4 = 0 as grid
from {{documents}}"""

#: A table image for each document: all its words in rows, every seventh row a line of running text, some faint.
BOXES_OF_WORDS = f"""
select 'doc' || cast(doc_id as string) as table_id, word_ord, text, cast(45 + {D} % 52 + (word_ord * 7) % 4 as double) as conf,
  cast(10 + (word_ord % (2 + {D} % 5)) * (case when floor(word_ord / (2 + {D} % 5)) % 7 = 0 then 100 else 140 end) + ({D} + word_ord) % 5 as int) as `left`,
  cast(10 + floor(word_ord / (2 + {D} % 5)) * 40 + ({D} * word_ord) % 5 as int) as top, cast(case when floor(word_ord / (2 + {D} % 5)) % 7 = 0 then 92 else 8 * least(length(text), 12) end as int) as width, cast(12 + word_ord % 4 as int) as height
from {{words}}"""

#: conf, left, top, width and height of a word, by its document, place and text.
_BOX = [
    f"cast(45 + {D} % 52 + (word_ord * 7) % 4 as double)", f"cast(10 + (word_ord % (2 + {D} % 5)) * (case when floor(word_ord / (2 + {D} % 5)) % 7 = 0 then 100 else 140 end) + ({D} + word_ord) % 5 as int)",
    f"cast(10 + floor(word_ord / (2 + {D} % 5)) * 40 + ({D} * word_ord) % 5 as int)", f"cast(case when floor(word_ord / (2 + {D} % 5)) % 7 = 0 then 92 else 8 * least(length(text), 12) end as int)", "cast(12 + word_ord % 4 as int)",
]


#: What a recogniser might say of a crop for each document: structures, too small ones, other text, nothing, errors.
PREDICTIONS_OF_DOCUMENTS = f"""
select doc_id + 100 as ord, 'ocsr_d' || cast(doc_id as string) as id, coalesce(source, 'none') as source_doc, cast({D} % 50 as int) as page_number,
  case {D} % 8 when 0 then 'CC(=O)Nc1ccc(O)cc1' when 1 then 'no structure' when 2 then ' ' when 3 then null when 4 then 'O' when 5 then 'CCOc1ccc(NC(C)=O)cc1' when 6 then 'Cn1c(=O)c2c(ncn2C)n(C)c1=O' else 'O=C(O)/C=C/C(=O)O' end as smiles,
  case when {D} % 13 = 0 then 'RuntimeError' end as error, cast({D} % 100 as double) / 100 as confidence
from {{documents}}"""

#: A name with a structure for each document; some structures are too small, some have two parts or brackets, some are no structures.
LEXICON_OF_DOCUMENTS = f"""
select 'n' || cast(doc_id as string) as name, repeat('C', cast({D} % 7 as int)) || case {D} % 5 when 0 then 'N.Cl' when 1 then '/C=C/' when 2 then 'c1ccccc1' when 3 then '[OH]' else ' (' end as smiles
from {{documents}}"""

#: Spellings of one structure each: other starts, branches and ring numbers, alternating bonds, brackets, stereochemistry, salts.
SPELLINGS = [
    ("ethanol", ["CCO", "OCC", "C(O)C", "[H]OCC", "[CH3][CH2][OH]", "[13CH3]CO"]), ("decalin", ["C1CCC2CCCCC2C1", "C12CCCCC1CCCC2", "C%10CCC%11CCCCC%11C%10"]), ("bicyclopentyl", ["C1CCC(C1)C1CCCC1", "C1CC(CC1)C2CCCC2"]),
    ("paracetamol", ["CC(=O)Nc1ccc(O)cc1", "Oc1ccc(cc1)NC(C)=O", "CC(=O)NC1=CC=C(O)C=C1", "C1(O)=CC=C(NC(C)=O)C=C1", "[Na+].[O-]c1ccc(NC(C)=O)cc1"]),
    ("caffeine", ["Cn1c(=O)c2c(ncn2C)n(C)c1=O", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C", "O=C1N(C)C(=O)c2c(ncn2C)N1C"]), ("butenedioic", ["O=C(O)/C=C/C(=O)O", "OC(=O)\\C=C/C(O)=O", "C(=CC(=O)O)C(O)=O"]),
    ("alanine", ["N[C@@H](C)C(=O)O", "C[C@H](N)C(O)=O", "[O-]C(=O)C(C)[NH3+]"]), ("nitromethane", ["C[N+](=O)[O-]", "CN(=O)=O", "O=N(C)=O"]), ("joined", ["C1.C1CC", "CCCC"]), ("small", ["O", "[OH2]"]),
    ("unsound", ["C(C", "C1CC", "CX", "C11", "C((C))", "=CC", "CC=", "C..C", "C=1CC-1", "C12CC12", "C(C)(C)(C)(C)C", "[Xx]", "*C", "C)C(C", "[CH3", ""]),
]

#: Words of the texts as molecules: a letter is an atom, so that a word read backwards, as a branch or as a ring begun elsewhere is the same structure.
_AS_ATOMS = "translate(word, 'abcdefghijklmnopqrstuvwxyz', 'CCNCOCCSCCNCOCCPNCSOCCCNCO')"
STRUCTURES_OF_WORDS = f"""
select word || ':chain' as name, {_AS_ATOMS} as smiles from {{words}} union all select word || ':chain' as name, reverse({_AS_ATOMS}) as smiles from {{words}}
union all select word || ':ring' as name, 'C1' || {_AS_ATOMS} || 'C=1' as smiles from {{words}} union all select word || ':ring' as name, 'C%12=C(' || {_AS_ATOMS} || '%12)' as smiles from {{words}}
union all select word || ':branch' as name, 'CC(' || {_AS_ATOMS} || 'c1ccccc1)F' as smiles from {{words}} union all select word || ':branch' as name, 'C1=CC=CC=C1' || reverse({_AS_ATOMS}) || 'C(F)C' as smiles from {{words}}"""

#: Answers from the turns of conversations, with suggestions of every form.
ANSWERS_OF_TURNS = """
select cast(100 + conv_id * 1000 + turn as bigint) as answer_id, text || case (conv_id + turn) % 6 when 0 then '' when 1 then ' <followups>["Why ' || cast(turn as string) || '?", " How? ", "How?"]</followups>'
  when 2 then ' <followups>["a", "b", "c", "d"] ' when 3 then ' <followups>[1, "x", null]</followups> more' when 4 then ' <followups>none</followups>' else ' <followups>{{"a": "b"}}</followups>' end as raw
from {conversations}"""

#: Texts with words that line breaks part, and with other hyphens.
PARTED_TEXTS = "select doc_id + 100 as id, replace(replace(text, 'ion ', 'i-' || chr(10) || ' on '), ' de ', ' d‑e ') as text from {documents}"

#: Pages whose words a hyphen joins.
HYPHENATED = "select doc_id, replace(replace(text, ' the ', '-the '), ' der ', ' der-') as text, source from {documents}"

FILENAMES = f"select case {D} % 4 when 0 then coalesce(source, '') || '_' || cast(doc_id as string) || '.pdf' when 1 then 'dir/' || cast(doc_id as string) || '.tar.gz' when 2 then '_' || cast(doc_id as string) else coalesce(source, '') || '.' end as filename from {{documents}}"

#: A raster of 12 rows of 8 for each document: ruled, speckled, or of one tone.
PIXELS_OF_DOCUMENTS = f"""
select 'doc' || cast(doc_id as string) as image, y, x, cast(case {D} % 3 when 0 then case when y % 4 = 0 then 10 else 250 end when 1 then ({D} * 37 + x * 29 + y * 53) % 256 else {D} % 200 + 20 end as int) as v
from {{documents}} cross join {{ys}} cross join {{xs}}"""

def facts_in_documents() -> str:
    """The page of facts in some documents, with other figures in each."""
    return f"""
select cast(doc_id + 10 as int) as rank, case when {D} % 3 = 0 then 'other.pdf' else '{C.FACT_DOCUMENT}' end as source_doc, cast({C.FACT_PAGE} as bigint) as page_number, text || case when {D} % 7 = 2 then ' ' || replace({sql_value(fact_page())}, '± 0.01', '± 0.0' || cast({D} % 9 as string)) else '' end as text
from {{documents}}"""


STRUCTURES = [
    (0, "ocsr_1", "A.pdf", 1, "CC(=O)Nc1ccc(O)cc1", None, 0.91), (1, "ocsr_2", "A.pdf", 1, "CC(=O)Nc1ccc(O)cc1", None, 0.8), (2, "ocsr_3", "A.pdf", 1, "not-smiles", None, None), (3, "ocsr_4", "A.pdf", 2, "", None, None),
    (4, "ocsr_5", "B.pdf", 1, "CC(=O)Nc1ccc(O)cc1", None, 0.7), (5, "ocsr_6", "B.pdf", 1, "O", None, None), (6, "ocsr_7", "B.pdf", 2, None, "RuntimeError", None),
]
TABLE_REPORT = [
    (0, "tbl_1", "A.pdf", 3, "accepted", None, 91.5, [["Compound", "%"], ["acetaminophen", "50"]], []), (1, "tbl_2", "A.pdf", 4, "refused", "low_confidence", 40.0, None, None),
    (2, "tbl_3", "A.pdf", 5, "skipped", "thin_table_rule", None, None, None), (3, "tbl_4", "B.pdf", 1, "accepted", None, 88.0, [["caption", "", ""], ["acetaminophen", "", "HPLC"]], [0]),
]
FACT_SUBJECT = "STRUCTURE"


def fact_page() -> str:
    """A page in the verified layout, with one whole table, one that lacks a row, and one of another substance."""
    def table(symbol: str, solvent: str, steps: list[float], base: float) -> str:
        rows = " ".join(f"{s:.1f} " + " ".join(f"{base + 10 * s + t / 10:.2f} ± 0.0{i + 1}" for i, t in enumerate((25, 30, 35, 40))) for s in steps)
        return f"{symbol} + {solvent} + water (x{symbol} × 102) {rows} "

    head = "Table 1. Figures for acetaminophen (A) and phenacetin (P) 25 ◦C 30 ◦C 35 ◦C 40 ◦C "
    return head + table("A", "DMSO", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0], 0.2) + table("A", "DMF", [0.2, 0.4, 0.6, 0.8, 1.0], 1.5) + table("A", "4FM", [0.2, 0.4, 0.8, 1.0], 2.5) + table("P", "DMF", [0.2, 0.4, 0.6, 0.8, 1.0], 3.5)


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def lexicon(spark: SparkSession) -> DataFrame:
    return frame(spark, LEXICON, "name string, smiles string")


def cache(spark: SparkSession) -> DataFrame:
    return frame(spark, CACHE, "name string, smiles string")


def sql_value(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(sql_value(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def sql_rows(rows: list, columns: str) -> str:
    """A VALUES list as a table expression."""
    body = ", ".join("(" + ", ".join(sql_value(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def spark_rows(statement: str, **tables: DataFrame) -> DataFrame:
    """A statement of this module over DataFrames."""
    return next(iter(tables.values())).sparkSession.sql(statement, **tables)


def duck_rows(statement: str, **tables: str) -> str:
    """The same as a table expression of SQL, over tables of the given names."""
    return "(" + statement.format(**tables).replace("`left`", '"left"') + ")"


def image_frame(spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    """The chosen images, and with documents theirs too."""
    features = "struct<white_frac:double,ink_frac:double,chroma:double,n_hlines:int,grid:boolean>"
    rows = frame(spark, [(*i, FEATURES.get(i[:3])) for i in IMAGES], f"filename string, page int, image_index int, width int, height int, features {features}")
    if documents is not None:
        own = F.when(F.col("decoded"), F.struct("white_frac", "ink_frac", "chroma", "n_hlines", "grid")).cast(features)
        rows = rows.unionByName(spark_rows(IMAGES_OF_DOCUMENTS, documents=documents).select("filename", "page", "image_index", "width", "height", own.alias("features")))
    return rows.withColumn("byte_size", F.lit(100)).withColumn("confidence", F.lit("heuristic"))


def box_frame(spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    """The chosen word boxes, and with documents one table image for each."""
    rows = frame(spark, word_boxes(), "table_id string, word_ord int, text string, conf double, left int, top int, width int, height int")
    if documents is None:
        return rows
    parted = documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("word_ord", "text"))
    return rows.unionByName(spark_rows(BOXES_OF_WORDS, words=parted))


def table_frame(spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    """``box_frame`` as (table_id, words), a row for each table image; documents of one id are one image, so only texts are moved."""
    rows = box_frame(spark).groupBy("table_id").agg(F.collect_list(F.struct("word_ord", "text", "conf", "left", "top", "width", "height")).alias("words"))
    if documents is None:
        return rows
    texts = documents.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    split = texts.select("doc_id", F.transform("texts", lambda t: words(t)).alias("split"))
    boxes = ", ".join(f"'{name}', {value}" for name, value in zip(("conf", "left", "top", "width", "height"), _BOX, strict=True))
    own = split.select("doc_id", F.expr(f"flatten(transform(split, ws -> transform(ws, (text, word_ord) -> named_struct('word_ord', word_ord, 'text', text, {boxes}))))").alias("words"))
    return rows.unionByName(own.select(F.expr("'doc' || cast(doc_id as string)").alias("table_id"), "words"))


def prediction_frame(spark: SparkSession, documents: DataFrame | None = None) -> DataFrame:
    rows = frame(spark, STRUCTURES, "ord long, id string, source_doc string, page_number int, smiles string, error string, confidence double")
    if documents is not None:
        rows = rows.unionByName(spark_rows(PREDICTIONS_OF_DOCUMENTS, documents=documents))
    return rows.withColumnRenamed("smiles", "predicted_smiles")
