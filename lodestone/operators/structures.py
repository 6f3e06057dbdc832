"""Structure keys from the graph of a molecule, whatever way its SMILES is written.

1. A SMILES is cut into symbols; windows over them find the atom that each atom is bonded to and what isn't well formed.
   ``molecules`` gathers a string's atoms and bonds, ``atom_table`` and ``bond_table`` give one row for each.
2. Hydrogens are counted by valence, so that a ring written with alternating bonds and one in aromatic letters agree.
   Explicit hydrogen atoms join the count of their neighbour.
3. Atoms that are connected are a fragment; the one with most heavy atoms stands for the molecule, the first of equals.
4. An atom's colour begins with its element and hydrogens and takes in its neighbours' colours round by round, until it
   says what surrounds it. Where atoms look alike, each of them is marked in turn and the rounds are run on, which tells
   apart rings that colours alone confuse. The sorted colours of all, and of every marked run, are the key's digest.

Bond orders, stereochemistry, isotopes and charges with the protons that go with them don't change the block. Tautomers
have blocks of their own. The block is not an InChIKey's: ``sources.adapters.rdkit_keyer`` gives that where RDKit is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone.functions.keys import parseable

#: (smiles) to (smiles, valid, key, block, heavy_atoms): how structures get their keys.
Keyer = Callable[[DataFrame], DataFrame]

#: Strings that one task takes, so that a query's few structures are keyed without any exchange.
ONE_TASK = 1_000

_AFTER = {"bond": ["atom", "ring", "open", "close"], "ring": ["atom", "ring", "bond", "close"], "open": ["atom", "ring", "close"], "close": ["atom", "ring", "close"], "dot": ["atom", "ring", "close"]}


def _distinct(smiles: DataFrame) -> DataFrame:
    return smiles.where("smiles is not null").select("smiles").distinct()


def _computed(rows: DataFrame) -> DataFrame:
    """One row a string, as it is, so that a condition on a column isn't put in place of it below and computed for each row again."""
    return rows.groupBy("smiles").agg(*[F.first(c).alias(c) for c in rows.columns if c != "smiles"])


def symbols(smiles: DataFrame) -> DataFrame:
    """Symbols of distinct strings (smiles): i, symbol, kind, and from their order depth, atom, anchor, parent, before, sound.

    ``atom`` numbers the atoms of a string; ``anchor`` is the atom that a ring bond or branch at this place belongs to,
    ``parent`` the one that an atom is bonded to; ``sound`` says whether the symbol may stand here.
    """
    cut = _distinct(smiles).select("smiles", F.regexp_extract_all("smiles", F.lit(C.SMILES_SYMBOL), F.lit(0)).alias("all"))
    rows = cut.select("smiles", (F.array_join("all", "") == F.col("smiles")).alias("whole"), F.posexplode_outer("all").alias("i", "symbol"))
    first = F.substring("symbol", 1, 1)
    kind = F.when(F.col("symbol") == "(", "open").when(F.col("symbol") == ")", "close").when(F.col("symbol") == ".", "dot").when(first.rlike("[0-9%]"), "ring").when(first.rlike(r"[-=#$:/\\]"), "bond").when(F.col("symbol").isNotNull(), "atom")
    string = Window.partitionBy("smiles").orderBy("i")
    so_far = string.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", kind).withColumns({
        "depth": F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(so_far),
        "atom": F.when(F.col("kind") == "atom", F.sum(F.when(F.col("kind") == "atom", 1)).over(so_far) - 1),
        "before": F.lag("kind").over(string), "symbol_before": F.lag("symbol").over(string), "last": F.lead("kind").over(string).isNull(),
    })
    # a branch is known by the bracket that opened it: the latest at its depth
    rows = rows.withColumn("branch", F.coalesce(F.max(F.when(F.col("kind") == "open", F.col("i"))).over(Window.partitionBy("smiles", "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1)))
    branch = Window.partitionBy("smiles", "depth", "branch").orderBy("i")
    rows = rows.withColumn("own", F.last("atom", ignorenulls=True).over(branch.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.coalesce("atom", F.when(F.col("kind") == "open", F.lag("own").over(string))))
    rows = rows.withColumn("anchor", F.last("start", ignorenulls=True).over(branch.rowsBetween(Window.unboundedPreceding, 0)))
    parent = F.when((F.col("kind") == "atom") & ~F.col("before").eqNullSafe(F.lit("dot")), F.last("start", ignorenulls=True).over(branch.rowsBetween(Window.unboundedPreceding, -1)))
    allowed = F.col("kind") == "atom"
    for name, after in _AFTER.items():
        allowed = allowed | ((F.col("kind") == name) & F.coalesce(F.col("before").isin(*after), F.lit(False)))
    closed = ~F.col("last") | ((F.col("depth") == 0) & F.col("kind").isin("atom", "ring", "close"))
    sound = F.coalesce(F.col("whole") & allowed & (F.col("depth") >= 0) & closed, F.lit(False))
    return rows.select("smiles", "i", "symbol", "kind", "depth", "atom", "anchor", parent.alias("parent"), F.when(F.col("before") == "bond", F.col("symbol_before")).alias("bond"), sound.alias("sound"))


def _order(bond: Column) -> Column:
    return F.when(bond == "=", 2).when(bond == "#", 3).when(bond == "$", 4).otherwise(1)


def _element(symbol: Column) -> Column:
    name = F.initcap(_name(symbol))
    return F.when(F.lit(f" {' '.join(C.ELEMENTS)} ").contains(F.concat(F.lit(" "), name, F.lit(" "))), name)


def _name(symbol: Column) -> Column:
    return F.when(symbol.startswith("["), F.regexp_extract(symbol, C.SMILES_BRACKET, 2)).otherwise(symbol)


def _charge(symbol: Column) -> Column:
    sign = F.regexp_extract(symbol, C.SMILES_BRACKET, 5)
    return F.when(sign == "", 0).when(sign.rlike("[0-9]"), sign.try_cast("int")).otherwise(F.length(sign) * F.when(sign.startswith("-"), -1).otherwise(1))


def _hydrogens(symbol: Column) -> Column:
    """Those that a bracket states; null for an atom without brackets."""
    stated = F.regexp_extract(symbol, C.SMILES_BRACKET, 4)
    return F.when(symbol.startswith("["), F.when(stated == "", 0).when(F.length(stated) == 1, 1).otherwise(F.substring(stated, 2, 9).try_cast("int")))


def _implied(element: Column, aromatic: Column, used: Column) -> tuple[Column, Column]:
    """(hydrogens, sound) of an atom without brackets, from the orders of its bonds."""
    valences = F.try_element_at(F.from_json(F.lit(json.dumps(C.VALENCES)), "map<string,array<int>>"), element)
    room = F.filter(valences, lambda v: v >= used)
    hydrogens = F.when(aromatic, F.greatest(F.lit(0), F.get(valences, 0) - used - 1)).otherwise(F.coalesce(F.get(room, 0) - used, F.lit(0)))
    return F.coalesce(hydrogens, F.lit(0)), aromatic | (F.size(room) > 0)


def _ring_bonds(rings: str) -> Column:
    """Bonds between the ends of each ring number, first with second, third with fourth; one that is left open, joins an atom to itself or has two orders isn't sound."""

    def closed(r: Column, k: Column) -> Column:
        earlier = F.filter(rings, lambda q, j: (j < k) & (q["label"] == r["label"]))
        later = F.exists(F.slice(F.col(rings), k + 2, F.size(rings)), lambda q: q["label"] == r["label"])
        other = F.element_at(earlier, -1)
        sound = (other["at"] != r["at"]) & F.coalesce(other["given"] == r["given"], F.lit(True))
        second = F.struct(other["at"].alias("a"), r["at"].alias("b"), F.coalesce(r["given"], other["given"], F.lit(1)).alias("bond_order"), F.coalesce(sound, F.lit(False)).alias("sound"))
        open_end = F.struct(r["at"].alias("a"), r["at"].alias("b"), F.lit(1).alias("bond_order"), F.lit(False).alias("sound"))
        return F.when(F.size(earlier) % 2 == 1, second).when(~later, open_end)

    return F.filter(F.transform(rings, closed), lambda b: b.isNotNull())


def molecules(smiles: DataFrame) -> DataFrame:
    """(smiles, valid, atoms, bonds) of distinct strings.

    ``atoms`` has element, hydrogens, charge, isotope, neighbours and sound in the order of the string, ``bonds`` the atoms
    a and b, bond_order and sound. Hydrogens are those of a bracket, or what the valence leaves room for.
    """
    marks = F.struct("i", "kind", "symbol", "atom", "anchor", "parent", "bond")
    rows = symbols(smiles).groupBy("smiles").agg(F.sort_array(F.collect_list(marks)).alias("marks"), F.min("sound").alias("sound"))
    given = F.transform(F.filter("marks", lambda m: m["kind"] == "ring"), lambda m: F.struct(m["anchor"].alias("at"), F.when(m["bond"].isNotNull(), _order(m["bond"])).alias("given"), F.ltrim(m["symbol"], F.lit("%")).cast("int").alias("label")))
    chain = F.transform(F.filter("marks", lambda m: m["parent"].isNotNull()), lambda m: F.struct(m["parent"].alias("a"), m["atom"].alias("b"), _order(m["bond"]).alias("bond_order"), F.lit(True).alias("sound")))
    rows = rows.withColumn("rings", given).withColumn("bonds", F.concat(chain, _ring_bonds("rings")))
    written = F.transform(F.filter("marks", lambda m: m["kind"] == "atom"), lambda m: m["symbol"])
    rows = rows.withColumn("written", written)

    def beside(_: Column, i: Column) -> Column:
        own = F.filter("bonds", lambda b: (b["a"] == i) | (b["b"] == i))
        return F.struct(F.aggregate(own, F.lit(0), lambda n, b: n + b["bond_order"]).alias("used"), F.sort_array(F.transform(own, lambda b: F.when(b["a"] == i, b["b"]).otherwise(b["a"]).cast("int"))).alias("to"))

    rows = rows.withColumn("beside", F.transform("written", beside))
    rows = rows.withColumn("read", F.transform("written", lambda w: F.struct(_element(w).alias("element"), F.lower(_name(w)).eqNullSafe(_name(w)).alias("aromatic"), _hydrogens(w).alias("stated"), _charge(w).alias("charge"), F.regexp_extract(w, C.SMILES_BRACKET, 1).alias("isotope"), w.startswith("[").alias("boxed"))))

    def whole(r: Column, i: Column) -> Column:
        near = F.get("beside", i)
        implied, fits = _implied(r["element"], r["aromatic"], near["used"])
        sound = r["element"].isNotNull() & r["charge"].isNotNull() & (F.size(F.array_distinct(near["to"])) == F.size(near["to"])) & F.when(r["boxed"], r["stated"].isNotNull()).otherwise(fits)
        return F.struct(r["element"].alias("element"), F.when(r["boxed"], r["stated"]).otherwise(implied).alias("hydrogens"), r["charge"].alias("charge"), F.when(r["boxed"], r["isotope"]).otherwise("").alias("isotope"), near["to"].alias("to"), F.coalesce(sound, F.lit(False)).alias("sound"))

    rows = rows.withColumn("atoms", F.transform("read", whole))
    valid = F.col("sound") & (F.size("atoms") > 0) & F.forall("atoms", lambda a: a["sound"]) & F.forall("bonds", lambda b: b["sound"])
    return _computed(rows.select("smiles", valid.alias("valid"), "atoms", "bonds"))


def bond_table(parsed: DataFrame) -> DataFrame:
    """(smiles, a, b, bond_order, sound): the bonds of ``molecules``, one row each."""
    return parsed.select("smiles", F.inline("bonds"))


def atom_table(parsed: DataFrame) -> DataFrame:
    """(smiles, atom, element, hydrogens, charge, isotope): the atoms of ``molecules``, one row each."""
    return parsed.select("smiles", F.posexplode("atoms").alias("atom", "x")).select("smiles", "atom", "x.element", "x.hydrogens", "x.charge", "x.isotope")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), 0)


def _rounds(colours: Column, times: Column) -> Column:
    """Colours after so many rounds, or once a round tells no more atoms apart: each takes in its neighbours', in order."""

    def around(c: Column) -> Column:
        return F.transform("near", lambda near, i: F.md5(F.concat(F.get(c, i), F.array_join(F.sort_array(F.transform(near, lambda j: F.get(c, j))), "")).cast("binary")))

    def state(c: Column, told: Column) -> Column:
        return F.struct(c.alias("c"), told.alias("told"), F.size(F.array_distinct(c)).alias("n"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["told"], s).otherwise(_let(around(s["c"]), lambda c: state(c, F.size(F.array_distinct(c)) == s["n"])))

    return F.aggregate(F.sequence(F.lit(1), times), state(colours, F.lit(False)), step, lambda s: s["c"])


def _together(colours: Column) -> Column:
    """One digest of the colours of the fragment's atoms, in whatever order they stand."""
    return F.md5(F.array_join(F.sort_array(F.transform(colours, lambda c, i: F.when(F.get("mine", i), c))), "").cast("binary"))


def structure_keys(smiles: DataFrame) -> DataFrame:
    """(smiles, valid, key, block, heavy_atoms) of distinct strings (smiles); all but the first two are null for what isn't a structure, key and block below the least size.

    ``key`` adds a digest of charges and isotopes to the block. Up to ``ONE_TASK`` strings are keyed at once, without any
    exchange, and go on as a table of their own: whatever gave them isn't run again for each use of their keys.
    """
    strings = _distinct(smiles)
    few = strings.limit(ONE_TASK + 1).collect()
    if len(few) > ONE_TASK:
        return _keys(strings)
    spark = smiles.sparkSession
    return spark.createDataFrame(_keys(spark.createDataFrame(few, "smiles string").coalesce(1)).collect(), "smiles string, valid boolean, key string, block string, heavy_atoms int").coalesce(1)


def _keys(strings: DataFrame) -> DataFrame:
    rows = molecules(strings).where("valid")
    heavy = F.transform("atoms", lambda a: a["element"] != "H")
    rows = rows.withColumn("heavy", heavy).withColumn("n", F.size("atoms"))
    rows = rows.withColumn("near", F.transform("atoms", lambda a, i: F.filter(a["to"], lambda j: F.get("heavy", i) & F.get("heavy", j))))
    own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i)
    lowest = F.aggregate(F.sequence(F.lit(1), F.col("n")), own, lambda c, _: F.transform("near", lambda near, i: F.array_min(F.concat(F.array(F.get(c, i)), F.transform(near, lambda j: F.get(c, j))))))
    rows = rows.withColumn("part", F.when(F.col("smiles").contains("."), lowest).otherwise(F.transform("atoms", lambda a: F.lit(0))))
    sizes = F.transform(F.array_distinct("part"), lambda p: F.struct(F.size(F.filter("part", lambda q, i: (q == p) & F.get("heavy", i))).alias("size"), (-p).alias("order")))
    rows = rows.withColumn("largest", F.array_max(sizes)).withColumn("mine", F.transform("part", lambda p, i: (p == -F.col("largest.order")) & F.get("heavy", i)))

    def label(a: Column) -> Column:
        protons = F.size(F.filter(a["to"], lambda j: ~F.get("heavy", j))) + a["hydrogens"]
        paired = F.exists(a["to"], lambda j: F.get("atoms", j)["charge"] != 0)
        return F.concat(a["element"], F.lit(":"), F.when(paired, protons).otherwise(protons - a["charge"]).cast("string"))

    times = F.expr("largest.size div 2 + 1")
    rows = rows.withColumn("colours", _rounds(F.transform("atoms", label), times))
    alike = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda v: F.get("mine", v) & (F.size(F.filter("colours", lambda c, i: F.get("mine", i) & (c == F.get("colours", v)))) > 1))
    marked = F.transform(alike, lambda v: _together(_rounds(F.transform("colours", lambda c, i: F.when(i == v, F.concat(c, F.lit("*"))).otherwise(c)), times)))
    block = F.upper(F.left(F.sha2(F.concat(_together(F.col("colours")), F.array_join(F.sort_array(marked), "")), 256), F.lit(14)))
    rest = F.transform("atoms", lambda a, i: F.when(F.get("mine", i) & ((a["charge"] != 0) | (a["isotope"] != "")), F.concat_ws(":", F.get("colours", i), a["charge"].cast("string"), a["isotope"])))
    rows = rows.withColumn("heavy_atoms", F.col("largest.size")).withColumn("block", F.when(F.col("heavy_atoms") >= C.MIN_HEAVY_ATOMS, block))
    key = F.concat(F.col("block"), F.lit("-"), F.upper(F.left(F.sha2(F.array_join(F.sort_array(rest), ""), 256), F.lit(10))))
    keyed = _computed(rows.select("smiles", key.alias("key"), "block", "heavy_atoms"))
    return strings.join(keyed.withColumn("valid", F.lit(True)), "smiles", "left").select("smiles", F.coalesce("valid", F.lit(False)).alias("valid"), "key", "block", "heavy_atoms")


def column_keyer(of: Callable[[Column], Column], parses: Callable[[Column], Column] = parseable) -> Keyer:
    """A keyer from an expression that gives (key, block, heavy_atoms) of a string."""

    def keyer(smiles: DataFrame) -> DataFrame:
        good = F.coalesce(parses(F.col("smiles")), F.lit(False))
        return _distinct(smiles).select("smiles", good.alias("valid"), of(F.col("smiles")).alias("k")).select("smiles", "valid", "k.key", "k.block", "k.heavy_atoms")

    return keyer


def with_keys(rows: DataFrame, keyer: Keyer = structure_keys, column: str = "smiles") -> DataFrame:
    """``rows`` with k (valid, key, block, heavy_atoms) of a column of strings; strings are keyed once each, however often they stand."""
    found = keyer(rows.select(F.col(column).alias("smiles"))).select(F.col("smiles").alias("keyed_smiles"), F.struct("valid", "key", "block", "heavy_atoms").alias("k"))
    return rows.join(found, F.col(column) == F.col("keyed_smiles"), "left").drop("keyed_smiles")

