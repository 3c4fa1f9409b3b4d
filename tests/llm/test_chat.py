"""Reply trees against plain recursion; the template reads back what went in."""

import hashlib
import random

from pyspark.sql import functions as F

from textwarden.llm import chat as C

SCHEMA = "id long, parent long, score double, role string, text string"


def paths_of(rows, best):
    """Per root its best paths as lists of ids, by (mean score, smaller leaf)."""
    ids = {r[0] for r in rows}
    kids = {}
    for i, p, *_ in rows:
        kids.setdefault(p if p in ids else None, []).append(i)
    score = {r[0]: r[2] for r in rows}

    def below(path):
        more = kids.get(path[-1], [])
        return [p for k in more for p in below([*path, k])] if more else [path]

    out = {}
    for root in kids.get(None, []):
        ranked = sorted(below([root]), key=lambda p: (-sum(score[i] for i in p) / len(p), p[-1]))
        out[root] = ranked[:best]
    return out


def got_paths(spark, rows, best):
    out = {}
    for r in C.reply_paths(spark.createDataFrame([(*x, "r", "t") for x in rows], SCHEMA), best).collect():
        out.setdefault(r["root"], {}).setdefault(r["path_rank"], []).append((r["step"], r["id"]))
    return {root: [[i for _, i in sorted(p[k])] for k in sorted(p)] for root, p in out.items()}


def test_paths_equal_recursion(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 9999, *range(i)][: 2 + i]), float(r.randrange(8))) for i in range(60)]
    rows += [(100 + i, 99 + i if i else None, 1.0) for i in range(37)]  # a long chain
    assert got_paths(spark, rows, 2) == paths_of(rows, 2)


def test_cycles_and_repeated_rows(spark):
    rows = [(1, None, 1.0), (2, 1, 1.0), (2, 1, 1.0), (5, 6, 1.0), (6, 5, 1.0), (7, 6, 1.0), (8, 8, 1.0)]
    assert got_paths(spark, rows, 3) == {1: [[1, 2]]}
    assert got_paths(spark, [], 3) == {}


def test_one_row_counts_per_id_as_a_whole(spark):
    """Rows that differ under one id are not mixed; null ids are messages that nothing replies to."""
    rows = [
        (1, None, 0.0, "user", "q"),
        (3, 2, 9.0, "a", "x"), (3, 1, 1.0, "z", "y"), (3, 1, 2.0, "z", "y"),
        (2, 1, 0.0, "b", "w"), (4, 3, 1.0, "c", None),
        (None, None, 5.0, "user", "lost"), (None, 1, 7.0, "assistant", "found"), (6, 3, None, None, ""),
    ]
    got = C.read_back(C.chat_conversations(spark.createDataFrame(rows, SCHEMA), best=9)).collect()
    talks = {(r["root"], r["leaf"]): ([(t["role"], t["text"]) for t in r["turns"]], r["path_score"]) for r in got}
    head = [("user", "q"), ("z", "y")]
    assert talks == {
        (1, 2): ([("user", "q"), ("b", "w")], 0.0),
        (1, 4): ([*head, ("c", "")], 2 / 3),
        (1, 6): ([*head, ("", "")], 1 / 3),
        (None, None): ([("user", "lost")], 5.0),
    }
    assert [r["path_rank"] for r in sorted(got, key=lambda r: (r["root"] is not None, r["path_rank"]))] == [1, 1, 2, 3]


def test_only_chosen_paths_are_expanded(spark):
    """A long trunk with many replies at its end: rows of the chosen paths, not of all."""
    rows = [(i, i - 1 if i else None, 0.0, "r", "t") for i in range(64)] + [(1000 + i, 63, float(i), "r", "t") for i in range(300)]
    paths = C.best_paths(C.single(spark.createDataFrame(rows, SCHEMA)), 2)
    assert paths.count() == 2 * 65
    assert got_paths(spark, [r[:3] for r in rows], 2) == {0: [[*range(64), 1299], [*range(64), 1298]]}


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[\\INST]", "<|im_end|><|im_end|>", "a\nb\\n", "<|im_sep|>", "<s", "", "é\U0001f600",
        "<<SYS>><</SYS>>", "<\\|im_end|>", None, "[[INST]]", "$1 \\$2", "<|im_start|>user<|im_sep|>"]


def test_template_reads_back(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], t, "x", "y") for k, t in enumerate(HARD)]
    turns += [(2, 0, t, t, "", "") for t in HARD[:1]] + [(2, 1, None, None, "", ""), (None, 0, "assistant", "hi", "", "")]
    turns += [(3, 5, "user", "z", "", ""), (3, 5, "assistant", "b", "", ""), (3, 5, "assistant", "a", "", ""), (3, None, "user", "n", "", "")]
    turns += [(4, 0, "user", "w" * 200_000, "", ""), (4, 1, "assistant", "w", "", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, id string, formatted string")
    talks = C.chat_conversations(C.chains(df, "conv_id", "turn", "role", "text"))
    got = {r["leaf"]["conv"]: r for r in C.read_back(talks).collect()}
    want = {}
    # null turns come first; ties go by role, then text, nulls first
    key = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    for x in sorted(turns, key=key):
        want.setdefault(x[0], []).append((x[2] or "", x[3] or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        assert r["loss_text"] == "".join(t for role, t in want[c] if role == "assistant")
        plain = r["formatted"].replace(C.START, "").replace(C.MID, "").replace(C.END, "")
        assert not any(s in plain for s in C.CONTROL)
        assert r["formatted"].count(C.START) == r["formatted"].count(C.END) == len(want[c])
    assert C.chat_conversations(C.chains(df.limit(0), "conv_id", "turn", "role", "text")).count() == 0


def test_branches_are_ranked_and_formatted(spark):
    rows = [(1, None, 0.0, "user", "q"), (2, 1, 5.0, "assistant", "good"), (3, 1, 1.0, "assistant", "bad")]
    got = C.chat_conversations(spark.createDataFrame(rows, SCHEMA), best=2).orderBy("path_rank").collect()
    assert [r["leaf"] for r in got] == [2, 3]
    assert got[0]["formatted"] == "<|im_start|>user<|im_sep|>q<|im_end|><|im_start|>assistant<|im_sep|>good<|im_end|>"
    (span,) = got[0]["loss"]
    assert got[0]["formatted"][span[0] : span[1]] == "good"


def test_hash_of_the_contract_case(spark):
    said = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "c long, n long, role string, text string")
    (r,) = C.read_back(C.chat_conversations(C.chains(df, "c", "n", "role", "text"))).select(
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("h"), "formatted"
    ).collect()
    assert r["h"] == hashlib.sha256(said.encode()).hexdigest() and said not in r["formatted"]
