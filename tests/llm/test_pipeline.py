"""The stages against brute force, and what they must leave alone."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard import brute as groups
from tests.llm.test_jaccard import near_copies
from textwarden.llm import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string"
KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    r = random.Random(11)
    texts = near_copies(r, 60, 5000)
    items = [" ".join(f"bench{i}x{j}" for j in range(12)) for i in range(5)]
    texts += [f"before {i} {t} after {i}" for i, t in enumerate(items)]
    texts += ["", " ", "123 !!", f'nothing token = "{KEY}" more words']
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", len(t), "x", "y") for i, t in enumerate(texts)]
    rows += [(9000, None, "en", "s0", None, "x", "y"), rows[0], (None, "nobody has this id", None, None, 5, "x", "y")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def by_id(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, world):
    path, rows = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = [(r[0], r[1]) for r in rows]

    told = P.known_language(spark, docs, path)
    seen = [x for x in seen if x[1] and any(c.isalpha() for c in x[1])]
    assert told.columns == docs.columns and by_id(told) == sorted(seen, key=str)

    one = P.one_of_each_group(spark, told, path)
    with_id = sorted({x for x in seen if x[0] is not None})
    leader = {d: g for d, _, g in groups(with_id, 5, 80)}
    seen = [x for x in with_id if leader[x[0]] == x[0]] + [x for x in seen if x[0] is None]
    assert one.columns == docs.columns and by_id(one) == sorted(seen, key=str)

    clean = P.without_benchmark(spark, one, path)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    gone = {d for d, *_ in leaks(seen, items, 5, 80)}
    assert len(gone) == 5
    seen = [x for x in seen if x[0] not in gone]
    assert clean.columns == docs.columns and by_id(clean) == sorted(seen, key=str)

    redacted = P.without_secrets(spark, clean, path)
    seen = [(d, t.replace(f'token = "{KEY}', "[REDACTED]")) for d, t in seen]
    assert redacted.columns == docs.columns and by_id(redacted) == sorted(seen, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.collect() if r["doc_id"] is not None)

    mixed = P.to_target_mix(spark, redacted, path)
    assert mixed.columns == docs.columns and set(by_id(mixed)) <= set(seen) and mixed.count() > 10


def test_run_and_release(spark, world):
    got = P.run(spark, world[0])
    rows = got.collect()
    assert rows and got.columns == spark.read.parquet(f"{world[0]}/documents.parquet").columns
    assert store.release(spark) > 0


def test_empty_documents(spark, world, tmp_path):
    spark.read.parquet(f"{world[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{world[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert "pipeline" in entry.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
