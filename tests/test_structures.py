from __future__ import annotations

import random

import pytest

from lodestone import constants as C
from lodestone.functions.keys import surrogate_key
from lodestone.operators import resolve, structures
from lodestone.plans import fixtures

RING = ["c1ccccc1", "n1ccccc1", "c1ccoc1"]


def molecule(rng: random.Random):
    """(elements, hydrogens or None, bonds): a random tree with some rings, at most four bonds an atom; boxed atoms carry their hydrogens."""
    n = rng.randrange(4, 16)
    elements = [rng.choice("CCCCNOS") for _ in range(n)]
    bonds: dict[tuple[int, int], int] = {}
    degree = [0] * n
    most = {"C": 4, "N": 3, "O": 2, "S": 2}
    for i in range(1, n):
        free = [j for j in range(i) if degree[j] < most[elements[j]]]
        if not free:
            return molecule(rng)
        j = rng.choice(free)
        bonds[j, i] = 1
        degree[i] += 1
        degree[j] += 1
    for _ in range(rng.randrange(4)):
        a, b = sorted(rng.sample(range(n), 2))
        if (a, b) not in bonds and degree[a] < most[elements[a]] and degree[b] < most[elements[b]]:
            bonds[a, b] = 1
            degree[a] += 1
            degree[b] += 1
    for a, b in list(bonds):
        if degree[a] < most[elements[a]] and degree[b] < most[elements[b]] and rng.random() < 0.2:
            bonds[a, b] = 2
            degree[a] += 1
            degree[b] += 1
    return elements, {i: most[e] - degree[i] for i, e in enumerate(elements)}, bonds


def spelled(rng: random.Random, elements, hydrogens, bonds) -> str:
    """One of many ways to write a molecule: any start, any order of branches, any ring numbers, some atoms in brackets."""
    near = {i: [] for i in range(len(elements))}
    for (a, b), o in bonds.items():
        near[a].append((b, o))
        near[b].append((a, o))
    seen, used, rings, numbers = set(), set(), {i: [] for i in near}, rng.sample(range(1, 100), 20)

    def walk(at, back):
        seen.add(at)
        out = []
        for b, o in rng.sample(near[at], len(near[at])):
            edge = frozenset((at, b))
            if b == back or edge in used:
                continue
            used.add(edge)
            if b in seen:
                number = numbers.pop()
                rings[at].append((number, o))
                rings[b].append((number, o))
            else:
                out.append((o, b, walk(b, at)))
        return out

    def write(at, branches) -> str:
        box = rng.random() < 0.2
        h = hydrogens[at]
        text = f"[{rng.choice(['', '13'])}{elements[at]}{'@' if rng.random() < 0.3 else ''}{'H' if h else ''}{h if h > 1 else ''}]" if box else elements[at]
        for number, o in rings[at]:
            text += "-=" [o - 1] * (o > 1) + (str(number) if number < 10 else f"%{number}")
        parts = [rng.choice(["", "-", "/"]) * (o == 1) + "=" * (o == 2) + write(b, more) for o, b, more in branches]
        return text + "".join(f"({p})" for p in parts[:-1]) + (parts[-1] if parts else "")

    start = rng.randrange(len(elements))
    return write(start, walk(start, None))


@pytest.fixture(scope="module")
def keys(spark):
    def of(strings):
        return {r.smiles: r for r in structures.structure_keys(spark.createDataFrame([(s,) for s in strings], "smiles string")).collect()}

    return of


def test_renumbered_molecules_have_one_block(keys):
    rng = random.Random(7)
    written = {}
    for i in range(200):
        m = molecule(rng)
        for _ in range(4):
            written[spelled(rng, *m)] = i
    found = keys(written)
    assert all(r.valid for r in found.values()), [s for s, r in found.items() if not r.valid][:3]
    blocks = {}
    for s, i in written.items():
        blocks.setdefault(i, set()).add(found[s].block)
    assert all(len(b) == 1 for b in blocks.values())


def test_chosen_spellings(keys):
    found = keys([s for _, group in fixtures.SPELLINGS for s in group])
    blocks = {}
    for name, group in fixtures.SPELLINGS:
        if name == "unsound":
            assert not any(found[s].valid or found[s].block for s in group)
        else:
            assert all(found[s].valid for s in group) and len({found[s].block for s in group}) == 1
            blocks[name] = found[group[0]].block
    assert blocks.pop("small") is None and len(set(blocks.values())) == len(blocks)
    assert found[fixtures.SUBJECT].block == fixtures.SUBJECT_BLOCK and found[fixtures.SUBJECT].heavy_atoms == 11
    assert found["CCO"].key != found["[13CH3]CO"].key and found["N[C@@H](C)C(=O)O"].key == found["C[C@H](N)C(O)=O"].key


def test_structures_that_colours_alone_confuse(keys):
    """Pairs of different graphs whose atoms have like surroundings."""
    pairs = [("C1CCC2CCCCC2C1", "C1CCC(C1)C1CCCC1"), ("C1CCCCC1.O", "C1CC1"), ("C1CC1C1CC1", "C1CC2CCC1C2"), ("C12C3C4C1C5C2C3C45", "C12C3C4C1C1C2C3C41"), ("CC(C)CC", "CCCCC"), ("c1ccccc1", "C1CCCCC1"), ("C12C3C1C23", "C1=CC=C1"), ("OCC=C", "C=COC")]
    found = keys([s for p in pairs for s in p])
    for a, b in pairs[:3] + pairs[4:]:
        assert found[a].block != found[b].block, (a, b)
    assert found[pairs[3][0]].block == found[pairs[3][1]].block


def test_atoms_and_bonds(spark):
    parsed = structures.molecules(spark.createDataFrame([("C1(=O)[NH+](C)C%11=1.[Cl-]%11",), (None,), ("c1cc[nH]c1",)], "smiles string"))
    bonds = sorted(tuple(r)[1:] for r in structures.bond_table(parsed).where("smiles like '%Cl%'").collect())
    assert bonds == [(0, 1, 2, True), (0, 2, 1, True), (0, 4, 2, True), (2, 3, 1, True), (2, 4, 1, True), (4, 5, 1, True)]
    atoms = sorted((r.atom, r.element, r.hydrogens, r.charge) for r in structures.atom_table(parsed).where("smiles like 'c1%'").collect())
    assert atoms == [(0, "C", 1, 0), (1, "C", 1, 0), (2, "C", 1, 0), (3, "N", 1, 0), (4, "C", 1, 0)]


def test_nulls_repeats_and_no_rows(spark):
    schema = "name string, smiles string, k int, valid int"
    rows = [("a", "CCO", 1, 2), ("b", "CCO", 1, 2), ("c", "OCC", 1, 2), ("d", None, 1, 2), ("e", "", 1, 2), ("f", " ", 1, 2), ("g", "C" * 200, 1, 2)]
    got = {r.name: r.k for r in structures.with_keys(spark.createDataFrame(rows, schema).drop("k", "valid")).collect()}
    assert got["a"] == got["b"] and got["a"].block == got["c"].block and got["d"] is None and not got["e"].valid and not got["f"].valid and got["g"].heavy_atoms == 200
    assert structures.structure_keys(spark.createDataFrame([], "smiles string")).collect() == []


def test_many_strings_are_keyed_alike(spark, keys, monkeypatch):
    strings = ["OCC", "CC(=O)Nc1ccc(O)cc1", "C1CC"]
    few = keys(strings)
    monkeypatch.setattr(structures, "ONE_TASK", 0)
    assert keys(strings) == few


def test_synonyms_meet_whatever_their_spelling(spark):
    names = spark.createDataFrame([("apap", "CC(=O)Nc1ccc(O)cc1"), ("paracetamol", "Oc1ccc(cc1)NC(C)=O"), ("water", "O"), ("odd", "C1CC"), ("ethanol", "OCC"), ("none", None)], "name string, smiles string")
    known = resolve.compounds(names)
    assert {r.name for r in known.collect()} == {"apap", "paracetamol", "ethanol"}
    assert [r.names for r in resolve.synonym_groups(known).collect()] == [["apap", "paracetamol"]]
    written = resolve.compounds(names, structures.column_keyer(surrogate_key))
    assert resolve.synonym_groups(written).collect() == []


def test_fixed_values():
    assert len(C.ELEMENTS) == 118 and set(C.VALENCES) <= set(C.ELEMENTS)
