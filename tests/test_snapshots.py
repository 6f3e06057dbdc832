from __future__ import annotations

from lodestone.sources import snapshots
from lodestone.sources.tables import LEXICON


def answers(spark, **given):
    return spark.createDataFrame(list(given.items()), LEXICON)


def cache_of(spark, path):
    return {r.name: r.smiles for r in snapshots.read_name_cache(spark, path).collect()}


def test_answers_stay_and_are_added(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert cache_of(spark, path) == {}
    assert snapshots.add_to_name_cache(answers(spark, a="C", b=None), path) == 1
    assert snapshots.add_to_name_cache(answers(spark, b="CC", c="CCC"), path) == 2
    assert cache_of(spark, path) == {"a": "C", "b": None, "c": "CCC"}
    assert snapshots.add_to_name_cache(answers(spark, d=None), path) == 3
    snapshots.forget(spark, path, 1)
    assert snapshots.versions(spark, path) == [3] and len(cache_of(spark, path)) == 4


def test_a_crash_leaves_the_last_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    snapshots.add_to_name_cache(answers(spark, a="C"), path)

    def crash(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_published", crash)
        try:
            snapshots.add_to_name_cache(answers(spark, b="CC"), path)
        except KeyboardInterrupt:
            pass
    assert cache_of(spark, path) == {"a": "C"}
    snapshots.add_to_name_cache(answers(spark, b="CCC"), path)
    assert cache_of(spark, path) == {"a": "C", "b": "CCC"}


def test_two_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    snapshots.add_to_name_cache(answers(spark, a="C"), path)
    publish, other = snapshots._published, []

    def late(spark_, folder, path_, number):
        if not other:
            other.append(True)
            assert snapshots.add_to_name_cache(answers(spark, b="first", c="other"), path) == 2
        return publish(spark_, folder, path_, number)

    monkeypatch.setattr(snapshots, "_published", late)
    assert snapshots.add_to_name_cache(answers(spark, b="second", d="own"), path) == 3
    assert cache_of(spark, path) == {"a": "C", "b": "first", "c": "other", "d": "own"}
