"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from textwarden.llm import (
    chat,
    decontaminate,
    infill,
    jaccard,
    language,
    mixing,
    periodic,
    quality,
    secrets,
    token_orc,
    tokens,
    vectors,
    warc,
)
from textwarden.llm.store import claimed, crc_fold, stored
from textwarden.sources.files import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of all documents; a source is the owner, its part in one language a repository."""
    docs = read_table(spark, sf, "documents")
    out = secrets.secret_scan(docs, "doc_id", "text", owner="source", repo="lang")
    n = lambda kind: F.size(F.filter("classes", lambda c: c == kind)).cast("long")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans",
        n("live").alias("n_live"), n("copied").alias("n_copied"),
        F.array_join("owners", ",").alias("owners"), F.array_join("repos", ",").alias("repos"),
    )


@query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words and word-piece tokens of every document."""
    return tokens.token_counts(read_table(spark, sf, "documents"), "doc_id", "text", *tokens.read_pieces(PIECES))


CRAWLED = "2024-01-01T00:00:00Z"  # the tables have no fetch time


@query
def op6_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    pages = read_table(spark, sf, "pages")
    records = warc.derivatives(warc.responses_of(pages, "page_id", "url", "html", CRAWLED))
    return records.withColumn("record_sha256", F.sha2(warc.as_bytes(), 256)).withColumnRenamed("key", "page_id")


MIX = {"source": F.col, "lang": F.col, "topic": lambda _: mixing.topic_of("text")}


def _mixture(spark: SparkSession, sf: str, cells_of) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    narrow = stored(
        docs.select("doc_id", "source", "lang", mixing.topic_of("text").alias("topic"),
                    mixing.token_weight("text").alias("tokens")),
        "mixture",
    )
    dims = {d: F.col(d) for d in MIX}
    cells = cells_of(narrow.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    rows = mixing.with_chance(narrow, dims, cells)
    return rows.select(
        "doc_id", "source", "lang", "topic", "tokens", F.col("__p").alias("p"), (mixing.draw("doc_id") < F.col("__p")).alias("drawn")
    )


@query
def op7_mixture_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its cell, tokens, calibrated probability and whether it is drawn.

    For the size at which no value has more than its target share of all tokens.
    """
    return _mixture(spark, sf, mixing.sized_cells)


@query
def op7_sized_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The same for a sample of a size that is given: half of all tokens."""
    return _mixture(spark, sf, lambda sums: mixing.sized_cells(sums, size=_HALF * sums.agg(F.sum("tokens")).first()[0]))


_HALF = 0.5


def _sql_mixture(size: str) -> str:
    """The same cells, sweeps and draw; ``size``: the expected tokens, from ``total`` and the targets."""
    topic = (
        "CASE WHEN text IS NULL THEN 'none' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shout'"
        " WHEN contains(text, '@') THEN 'contact' WHEN length(text) < 500 THEN 'note' ELSE 'prose' END"
    )
    words = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
    parts = [
        f"narrow AS MATERIALIZED (SELECT doc_id, source, lang, {topic} AS topic, CAST({words} AS BIGINT) AS tokens FROM documents)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM narrow GROUP BY ALL)",
        "total AS MATERIALIZED (SELECT sum(tokens) AS tokens FROM cells)",
    ]
    for d in MIX:
        parts.append(
            f"m_{d} AS MATERIALIZED (SELECT {d}, sum(tokens) AS n, CASE WHEN sum(tokens) > 0 THEN"
            f" pow(sum(tokens), {mixing.ALPHA}::DOUBLE) ELSE 0 END AS s FROM cells GROUP BY {d})"
        )
        parts.append(f"h_{d} AS MATERIALIZED (SELECT {d}, n, s / (SELECT sum(s) FROM m_{d}) AS share FROM m_{d})")
    parts.append(f"size AS MATERIALIZED (SELECT {size} AS tokens)")

    def filled(rows: str, cap: str, weight: str, goal: str, by: str = "") -> str:
        """Rows with ``level``: the factor at which the weights, each up to its cap, sum to the goal."""
        over = f"({by} ORDER BY CASE WHEN {weight} > 0 THEN {cap} / {weight} ELSE 0 END"
        return (
            f"SELECT *, max(CASE WHEN rest > 0 THEN ({goal} - before) / rest END) OVER ({by}) AS level FROM (SELECT *,"
            f" coalesce(sum({cap}) OVER {over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,"
            f" sum({weight}) OVER {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {rows})"
        )

    for d in MIX:
        level = filled(f"h_{d}", "n", "share", "(SELECT tokens FROM size)")
        parts.append(f"t_{d} AS MATERIALIZED (SELECT {d}, least(n, share * level) AS t_{d} FROM ({level}))")
    joins = " ".join(f"JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.{d}" for d in MIX)
    targets = ", ".join(f"t_{d}" for d in MIX)
    parts.append(f"s0 AS MATERIALIZED (SELECT c.*, {targets}, c.tokens AS w FROM cells c {joins})")
    i = 0
    for _ in range(mixing.SWEEPS):
        for d in MIX:
            level = filled(f"s{i}", "tokens", "w", f"t_{d}", f"PARTITION BY {d}")
            parts.append(
                f"s{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, {targets},"
                f" w * greatest(coalesce(level, 0), 0) AS w FROM ({level}))"
            )
            i += 1
    level = filled(f"s{i}", "tokens", "w", "(SELECT tokens FROM size)")
    parts.append(
        "p AS MATERIALIZED (SELECT source, lang, topic, least(1.0::DOUBLE, floor(CASE WHEN tokens > 0 THEN"
        f" least(tokens, w * coalesce(level, 0)) / tokens ELSE 0 END * 1e9 + 0.500001::DOUBLE) / 1e9) AS p FROM ({level}))"
    )
    same = " AND ".join(f"n.{d} IS NOT DISTINCT FROM p.{d}" for d in MIX)
    drawn = "CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE < p"
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, n.source, n.lang, n.topic, n.tokens, p, {drawn} AS drawn FROM narrow n JOIN p ON {same}"
    )


_LEFT = ", ".join(f"(SELECT sum(least(n, share * (SELECT tokens FROM total))) FROM h_{d})" for d in MIX)
ORACLES["op7_mixture_sample"] = _sql_mixture(f"least({_LEFT})")
ORACLES["op7_sized_sample"] = _sql_mixture(f"{_HALF}::DOUBLE * (SELECT tokens FROM total)")


@query
def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and one that says control strings, formatted and read back."""
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    talks = chat.chat_conversations(chat.chains(turns.unionByName(own), "conv_id", "turn", "role", "text"))
    read = chat.read_back(talks)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("leaf.conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_chat() -> str:
    def esc(c: str) -> str:
        c = f"replace(coalesce({c}, ''), '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
        for s in chat.CONTROL:
            c = f"replace({c}, '{s}', '{s[0] + chat.ESCAPE + s[1:]}')"
        return c

    marks = len(chat.START + chat.MID + chat.END)
    order = "ORDER BY turn, role, text"
    learnt = f"coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')"
    return f"""WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      CAST(length({learnt}) AS BIGINT) AS loss_chars, sha256({learnt}) AS loss_sha256,
      CAST(sum({marks} + length({esc('role')}) + length({esc('text')})) AS BIGINT) AS formatted_chars
    FROM said GROUP BY conv_id"""


ORACLES["op9_chat_format"] = _sql_chat()


OTHERWISE = "Put in another way: "


@query
def op9_reply_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with a second answer to every prompt, one of which goes on: the two best branches of each.

    A message scores the last digit of its length.  Turns repeated in a conversation are siblings too.
    """
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    one = turns.distinct()
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    both = one.withColumn("v", F.explode(F.when(answer, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("v") == 1, F.concat(F.lit(OTHERWISE), "text")).otherwise(F.col("text"))
    rows = both.withColumn("text", text).withColumn("id", F.struct("conv_id", "turn", "role", "text"))
    # the message of the turn before to which the next turns reply
    on = rows.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.max("id").alias("parent"))
    messages = rows.join(on, ["conv_id", "turn"], "left").withColumn("score", (F.length("text") % 10).cast("double"))
    talks = chat.chat_conversations(messages.select("id", "parent", "score", "role", "text"), best=2)
    return talks.select(
        F.col("root.conv_id").alias("conv_id"), F.col("root.turn").alias("first_turn"), F.col("leaf.turn").alias("last_turn"),
        "path_rank", F.floor(F.col("path_score") * 1e6 + 0.5).alias("score_millionths"),
        F.sha2(F.col("formatted").cast("binary"), 256).alias("formatted_sha256"),
        F.size("loss").cast("long").alias("learnt"),
    )


def _sql_trees() -> str:
    def esc(c: str) -> str:
        c = f"replace(coalesce({c}, ''), '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
        for s in chat.CONTROL:
            c = f"replace({c}, '{s}', '{s[0] + chat.ESCAPE + s[1:]}')"
        return c

    turn = f"'{chat.START}' || {esc('role')} || '{chat.MID}' || {esc('text')} || '{chat.END}'"
    return f"""WITH RECURSIVE one AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    rows AS MATERIALIZED (SELECT conv_id, turn, role, text FROM one UNION
      SELECT conv_id, turn, role, '{OTHERWISE}' || text FROM one WHERE role = 'assistant'),
    m AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS id,
      row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC, text DESC) AS down,
      CAST(length(text) % 10 AS DOUBLE) AS score, {turn} AS f FROM rows),
    e AS MATERIALIZED (SELECT m.*, p.id AS parent FROM m
      LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 AND p.down = 1),
    walk AS (SELECT id, id AS root, conv_id, turn AS first_turn, turn, 1 AS many, score AS total, f AS formatted,
        CAST(role = 'assistant' AS BIGINT) AS learnt FROM e WHERE parent IS NULL
      UNION ALL SELECT e.id, w.root, w.conv_id, w.first_turn, e.turn, w.many + 1, w.total + e.score, w.formatted || e.f,
        w.learnt + CAST(e.role = 'assistant' AS BIGINT) FROM walk w JOIN e ON e.parent = w.id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY root ORDER BY total / many DESC, id) AS INTEGER) AS path_rank
      FROM walk WHERE id NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL))
    SELECT conv_id, first_turn, turn AS last_turn, path_rank, CAST(floor(total / many * 1e6 + 0.5) AS BIGINT) AS score_millionths,
      sha256(formatted) AS formatted_sha256, learnt FROM r WHERE path_rank <= 2"""


ORACLES["op9_reply_trees"] = _sql_trees()


WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x20\x09-\x0D]+')"
)


def _sql_shingles(width: int) -> str:
    """Distinct shingles as a list; all words as one if they are fewer."""
    parts = ", ".join("w" if not j else f"w[{j + 1}:]" for j in range(width))
    joined = " || chr(1) || ".join(f"z[{j + 1}]" for j in range(width))
    return (
        f"CASE WHEN len(w) >= {width} THEN list_distinct([{joined} FOR z IN list_zip({parts})"
        f" IF z[{width}] IS NOT NULL]) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END"
    )


@query
def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents by three-word shingles and nine tenths."""
    return jaccard.jaccard_join(read_table(spark, sf, "documents"), "doc_id", "text", width=3, percent=90)


@query
def op5_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The links behind these components: all pairs of class leaders, and the copies of each leader."""
    return jaccard.jaccard_pairs(read_table(spark, sf, "documents"), "doc_id", "text", width=3, percent=90)


@query
def op5_link_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each document links with."""
    return jaccard.link_counts(read_table(spark, sf, "documents"), "doc_id", "text", width=3, percent=90)


ORACLES["op5_jaccard_join"] = f"""WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, {_sql_shingles(3)} AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(t.t) AS t FROM sets, unnest(s) AS t(t)),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.t = b.t AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, len(s.s)"""


@query
def op10_benchmark_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and the documents that hold four fifths of their five-word shingles."""
    docs, items = read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark")
    return decontaminate.leaks(docs, "doc_id", "text", items, "item_id", "text")


ORACLES["op10_benchmark_leaks"] = f"""WITH words AS MATERIALIZED (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
iwords AS MATERIALIZED (SELECT item_id, coalesce({WORDS_SQL}, []) AS w FROM benchmark),
items AS MATERIALIZED (SELECT item_id, len(s) AS n, t.t AS t FROM (SELECT item_id, {_sql_shingles(5)} AS s FROM iwords), unnest(s) AS t(t)),
shingles AS MATERIALIZED (SELECT doc_id, t.t AS t FROM (SELECT doc_id, {_sql_shingles(5)} AS s FROM words), unnest(s) AS t(t))
SELECT doc_id, item_id, count(*) AS n_shared, CAST(n AS BIGINT) AS n_item FROM shingles JOIN items USING (t)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n"""


@query
def op2_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    rows = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("long").alias("id"), vectors.quantised("embedding").alias("v")
    )
    found = vectors.top_k(rows, rows.filter("id % 50 = 0"), 5)
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op2_exact_top_k"] = """WITH v AS MATERIALIZED (
  SELECT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 50 = 0 AND q.id <> c.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query
def op3_language_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Language shares of all documents; learnt from four fifths of them."""
    docs = read_table(spark, sf, "documents").withColumn("__fold", crc_fold("doc_id"))
    model = language.train(docs.filter("__fold <> 0"), "text", "lang")
    out = language.identify(docs, {"doc_id": "doc_id", "__fold": "__fold"}, "text", model)
    return out.select("doc_id", (F.col("__fold") == 0).alias("held_out"), "lang_pred", "score", "mixture")


@query
def op8_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of all documents; labels learnt from four fifths of them."""
    docs = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels").filter(crc_fold("doc_id") != 0)
    weights = quality.train(docs, "doc_id", "text", labels, "doc_id", "quality")
    out = quality.score(docs, {"doc_id": "doc_id"}, "text", weights)
    return out.select(
        "doc_id", (crc_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query
def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    """All documents cut and put in a new order, and rebuilt from that."""
    docs = read_table(spark, sf, "documents")
    out = infill.restored(infill.fill_in_middle(docs, "doc_id", "text"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha("output").alias("output_sha256"), sha("restored").alias("restored_sha256"),
    )


def _sql_infill() -> str:
    p, s, m = infill.PREFIX, infill.SUFFIX, infill.MIDDLE
    h = lambda i: f"CAST('0x' || substr(sha256('{infill.SEED}:' || doc_id), {8 * i + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"array_to_string(l[{a}:{b}], '')"
    marked = " OR ".join(f"contains(t, '{x}')" for x in (p, s, m))
    return f"""WITH lines AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
    drawn AS (SELECT *, CAST(len(l) AS BIGINT) AS n, {h(0)} % (len(l) + 1) AS x, {h(1)} % (len(l) + 1) AS y,
      CASE WHEN t = '' OR {marked} OR {h(2)} % 100 >= {infill.FIM_PERCENT} THEN 'plain'
        WHEN {h(3)} % 100 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM lines),
    parts AS (SELECT *, {part(1, 'least(x, y)')} AS a, {part('least(x, y) + 1', 'greatest(x, y)')} AS b,
      {part('greatest(x, y) + 1', 'n')} AS c FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || a || '{s}' || c || '{m}' || b
        ELSE '{s}' || c || '{p}' || a || '{m}' || b END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM parts"""


ORACLES["op11_fill_in_middle"] = _sql_infill()


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, of which a tenth go on from some word in a period drawn from a hash of their id."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("w")
    cut = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.floor((n - F.col("a")) / (g % 8 + 3)) + 1)
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform("w", lambda _, i: F.get("w", at(i).cast("int"))), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of which are made to repeat, and what is left without them."""
    found = periodic.periodic_runs(with_repeats(read_table(spark, sf, "documents")), "doc_id", "text")
    # the longest, of these the first, of these the one of the smallest period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("top", F.array_min(order)).withColumn("length", -F.col("top.l"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.s").alias("start"),
        "length",
        F.col("top.p").alias("period"),
        F.floor(F.col("length") * 1000 / F.col("top.p")).alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
        "n_dropped",
    )


BYTES = public_tokenizers.path("byte_bpe_50k.json")


@query
def op13_token_orc(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of all documents written as ORC, and the index of the documents read back from the files."""
    docs, path = read_table(spark, sf, "documents"), claimed(spark, "token-orc")
    token_orc.write_tokens(docs, path, "doc_id", "text", BYTES)
    return token_orc.document_index(token_orc.read_tokens(spark, path))
