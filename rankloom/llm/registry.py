"""Queries of the training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import consensus, covering, leaks, lookalike, mixing, spans, springrank, topn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of all models of the verdict log."""
    return springrank.rank_models(_read(spark, sf_dir, "verdicts")).select("rank_no", "model")


def p1_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking with strengths and numbers of comparisons."""
    return springrank.rank_models(_read(spark, sf_dir, "verdicts")).withColumn("strength", F.round("strength", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus winner of every item of the panel."""
    return consensus.consensus(_read(spark, sf_dir, "panel"))[0].select("qid", "model_a", "model_b", "winner")


def p2_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ability and agreement of every judge."""
    found = consensus.consensus(_read(spark, sf_dir, "panel"))[1]
    return found.select("judge", "n_votes", F.round("ability", 6).alias("ability"), F.round("agreement", 6).alias("agreement"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance-corrected agreement of the whole panel."""
    found = consensus.krippendorff(consensus.votes_of(_read(spark, sf_dir, "panel"))[1])
    return found.select("n_items", "n_votes", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every model and query."""
    return topn.top_documents(_read(spark, sf_dir, "ranked"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs of corpus passages and of queries."""
    rows = covering.near_rows(_read(spark, sf_dir, "corpus"), "doc_id", "text", "corpus").unionByName(
        covering.near_rows(_read(spark, sf_dir, "queries"), "qid", "text", "queries")
    )
    return covering.near_pairs(rows).withColumnRenamed("space", "tbl")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and connected group of every passage and query."""
    rows = covering.near_rows(_read(spark, sf_dir, "corpus"), "doc_id", "text", "corpus").unionByName(
        covering.near_rows(_read(spark, sf_dir, "queries"), "qid", "text", "queries")
    )
    return covering.near_groups(rows).withColumnRenamed("space", "tbl")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages and of queries that look the same but are stored with other characters."""
    return lookalike.same_look_pairs(_read(spark, sf_dir, "corpus"), "doc_id", "text", "corpus").unionByName(
        lookalike.same_look_pairs(_read(spark, sf_dir, "queries"), "qid", "text", "queries")
    )


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that looks like a row stored with other characters, with its class."""
    return lookalike.same_look_classes(_read(spark, sf_dir, "corpus"), "doc_id", "text", "corpus").unionByName(
        lookalike.same_look_classes(_read(spark, sf_dir, "queries"), "qid", "text", "queries")
    )


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every passage and query, and whether it differs from the stored text."""
    corpus = _read(spark, sf_dir, "corpus").select(F.lit("corpus").alias("tbl"), F.col("doc_id").alias("key"), "text")
    queries = _read(spark, sf_dir, "queries").select(F.lit("queries").alias("tbl"), F.col("qid").alias("key"), "text")
    both = lookalike.with_form(corpus.unionByName(queries))
    return both.select("tbl", "key", "form", (F.col("form") != F.col("text")).alias("changed"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which twelve consecutive words stand in them."""
    return leaks.verbatim_leaks(_read(spark, sf_dir, "documents"), "doc_id", _read(spark, sf_dir, "benchmark"), "item_id").select("doc_id", "item_id")


def p6_reparameterised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat an item with numbers, names or units replaced."""
    return leaks.reparameterised_leaks(_read(spark, sf_dir, "documents"), "doc_id", _read(spark, sf_dir, "benchmark"), "item_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate and the number of copies of every document in the mix."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets")).documents


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reaches, by source."""
    return mixing.mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets")).sources


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of characters that stand verbatim in another document."""
    return spans.shared_spans(_read(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document is shared."""
    return spans.shared_shares(_read(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict:
    """name -> f(spark, sf_dir)."""
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit() and callable(f)}


_NAME = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SAID = lambda c: rf"""(CASE regexp_replace(lower(regexp_replace({_NAME(c)}, '\.+$', '')), '^system ', '') WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 WHEN 'b' THEN 0.0 END)"""


_SPANS = """WITH p AS (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS s FROM documents WHERE length(text) >= 300),
  w AS (SELECT doc_id, s, hash(substr(text, s + 1, 300)) AS h, md5_number(substr(text, s + 1, 300)) AS h2 FROM p),
  k AS (SELECT h, h2 FROM w GROUP BY h, h2 HAVING min(doc_id) < max(doc_id)), g AS (SELECT doc_id, s FROM w JOIN k USING (h, h2)),
  m AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 300 THEN 0 ELSE 1 END AS new FROM g),
  r AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m) SELECT doc_id, min(s) AS span_start, max(s) + 300 AS span_end FROM r GROUP BY doc_id, run"""


# The spring system solved by elimination, one pivot a recursion step.
_SPRINGS = f"""WITH RECURSIVE l AS (SELECT query_set, qid, judge, line_no, {_NAME("model_a")} AS a, {_NAME("model_b")} AS b, score_a AS s, coalesce(list_bool_and(list_transform(parsed_ok, lambda x: coalesce(x, false))), true) AS ok FROM verdicts),
  t AS (SELECT query_set, qid, judge, line_no, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN a < b THEN s ELSE 1 - s END AS s, ok FROM l WHERE a <> b),
  c AS (SELECT lo, hi, arg_max(struct_pack(s := s, ok := ok), line_no) AS r FROM t GROUP BY query_set, qid, judge, lo, hi),
  g AS (SELECT lo, hi, count(*) FILTER (r.ok AND r.s IS NOT NULL) AS n, coalesce(sum(2 * r.s - 1) FILTER (r.ok), 0) AS d FROM c GROUP BY lo, hi),
  e AS MATERIALIZED (SELECT lo AS i, hi AS j, n, d FROM g UNION ALL SELECT hi, lo, n, -d FROM g),
  names AS MATERIALIZED (SELECT i AS model, row_number() OVER (ORDER BY i) AS k, CAST(sum(n) AS BIGINT) AS games, sum(d) AS net, count(*) OVER () AS n FROM e GROUP BY i),
  cells AS (SELECT a.k AS r, b.k AS c, CASE WHEN a.k = b.k THEN a.games + {springrank.ALPHA} ELSE -coalesce(e.n, 0) END AS v FROM names a CROSS JOIN names b LEFT JOIN e ON e.i = a.model AND e.j = b.model UNION ALL SELECT k, n + 1, net FROM names),
  m AS (SELECT 1 AS k, list(row ORDER BY r) AS m, count(*) AS n FROM (SELECT r, list(CAST(v AS DOUBLE) ORDER BY c) AS row FROM cells GROUP BY r) UNION ALL
    SELECT k + 1, list_transform(m, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = k THEN x / m[k][k] ELSE x - row[k] / m[k][k] * m[k][j] END)), n FROM m WHERE k <= n),
  x AS (SELECT model, games, m.m[names.k][m.n + 1] AS strength FROM names JOIN m ON m.k = m.n + 1)
  SELECT CAST(row_number() OVER (ORDER BY strength DESC, model) AS INTEGER) AS rank_no, model, round(strength, 6) AS strength, games FROM x"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _forms() -> str:
    """f(tbl, key, text, form) of both tables: invisible characters go, what composes is composed, single characters are
    mapped by the transducer's table, and what composes then is composed. No cluster is looked at as a whole."""
    alone = {k: v for k, v in lookalike.TABLE.items() if len(k) == 1 and unicodedata.normalize("NFC", k) == k and k not in lookalike._HIDDEN}
    codes, ranges = sorted(map(ord, lookalike._HIDDEN)), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    hidden = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    x = f"nfc_normalize(regexp_replace(replace(text, chr(13) || chr(10), ' '), '[{hidden}]', '', 'g'))"
    for k, v in alone.items():
        if len(v) > 1:
            x = f"replace({x}, {_quoted(k)}, {_quoted(v)})"
    one = {k: v for k, v in alone.items() if len(v) == 1}
    x = f"nfc_normalize(translate({x}, {_quoted(''.join(one))}, {_quoted(''.join(one.values()))}))"
    return f"s AS (SELECT 'corpus' AS tbl, doc_id AS key, text FROM corpus UNION ALL SELECT 'queries', qid, text FROM queries), f AS MATERIALIZED (SELECT tbl, key, text, {x} AS form FROM s)"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries it can express on whole tables. The others are tested against brute force."""
    return {
        "p1_strengths": _SPRINGS,
        "p1_found": f"SELECT rank_no, model FROM ({_SPRINGS})",
        "p2_agreement": f"""WITH l AS (SELECT line_no, qid, judge, {_NAME("model_a")} AS a, {_NAME("model_b")} AS b, coalesce(score_a, ({_SAID("raw[1]")} + 1 - {_SAID("raw[2]")}) / 2) AS s FROM panel
  WHERE coalesce(list_bool_and(list_transform(parsed_ok, lambda x: coalesce(x, false))), true)),
  t AS (SELECT qid, judge, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN a < b THEN s ELSE 1 - s END AS s, line_no FROM l WHERE a <> b AND s IS NOT NULL),
  v AS (SELECT qid, lo, hi, arg_max(s, line_no) AS s FROM t GROUP BY qid, lo, hi, judge),
  c AS (SELECT count(*) AS m, count(*) FILTER (s > 0.5) AS n0, count(*) FILTER (s < 0.5) AS n1, count(*) FILTER (s = 0.5) AS n2 FROM v GROUP BY qid, lo, hi HAVING count(*) > 1),
  x AS (SELECT count(*) AS n_items, CAST(sum(m) AS BIGINT) AS n_votes, sum((m * m - n0 * n0 - n1 * n1 - n2 * n2) / (m - 1)) AS apart, CAST(sum(n0) AS DOUBLE) AS t0, CAST(sum(n1) AS DOUBLE) AS t1, CAST(sum(n2) AS DOUBLE) AS t2 FROM c),
  y AS (SELECT n_items, n_votes, apart / n_votes AS o, (CAST(n_votes AS DOUBLE) * n_votes - t0 * t0 - t1 * t1 - t2 * t2) / (CAST(n_votes AS DOUBLE) * (n_votes - 1)) AS e FROM x)
  SELECT n_items, n_votes, round(o, 9) AS observed, round(e, 9) AS expected, round(1 - o / e, 9) AS alpha FROM y""",
        "p3_found": """WITH e AS (SELECT model, qid, unnest(doc_ids) AS doc_id, unnest(scores) AS score FROM ranked),
  b AS (SELECT model, qid, doc_id, max(score) AS score FROM e WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY model, qid, doc_id),
  r AS (SELECT model, qid, CAST(row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank_no, doc_id FROM b) SELECT * FROM r WHERE rank_no <= 10""",
        "p6_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
  dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
  iw AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12))
  SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
        "p8_found": _SPANS,
        "p8_shares": f"""WITH spans AS ({_SPANS}), t AS (SELECT doc_id, sum(span_end - span_start) AS c, count(*) AS n FROM spans GROUP BY doc_id), z AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
  SELECT doc_id, n_chars, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, coalesce(n, 0) AS n_spans, CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars END AS share FROM z LEFT JOIN t USING (doc_id)""",
        "p5_forms": f"WITH {_forms()} SELECT tbl, key, form, form <> text AS changed FROM f",
        "p5_found": f"""WITH {_forms()}, r AS (SELECT DISTINCT tbl, key, text, form FROM f WHERE key IS NOT NULL AND text IS NOT NULL)
  SELECT DISTINCT a.tbl, a.key AS key_a, b.key AS key_b FROM r a JOIN r b ON a.tbl = b.tbl AND a.form = b.form AND a.key < b.key AND a.text <> b.text""",
        "p5_classes": f"""WITH {_forms()}, r AS (SELECT DISTINCT tbl, key, text, form FROM f WHERE key IS NOT NULL AND text IS NOT NULL),
  c AS (SELECT tbl, form, min(key) AS class_id, count(DISTINCT key) AS n_keys, count(DISTINCT text) AS n_texts FROM r GROUP BY tbl, form HAVING count(DISTINCT text) > 1) SELECT DISTINCT tbl, key, form, class_id, n_keys, n_texts FROM r JOIN c USING (tbl, form)""".replace("SELECT DISTINCT tbl, key, form, class_id", "SELECT tbl, key, class_id").replace("FROM r JOIN c", "FROM (SELECT DISTINCT tbl, key, form FROM r) JOIN c"),
        "p4_found": f"""WITH {_forms()}, w AS MATERIALIZED (SELECT DISTINCT tbl, key, list_sort(list_distinct(regexp_extract_all(translate(lower(form), {_quoted("".join(lookalike.FOLD))}, {_quoted("".join(lookalike.FOLD.values()))}), '[\\p{{L}}\\p{{N}}]+'))) AS w
    FROM f WHERE key IS NOT NULL AND text IS NOT NULL), x AS (SELECT tbl, key, w, len(w) AS n FROM w WHERE len(w) > 0)
  SELECT DISTINCT a.tbl, a.key AS key_a, b.key AS key_b FROM x a JOIN x b ON a.tbl = b.tbl AND a.key < b.key AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
    AND len(list_intersect(a.w, b.w)) >= 0.8 * (a.n + b.n - len(list_intersect(a.w, b.w))) - 1e-9""",
    }
