"""DuckDB SQL of the queries, with the same columns. Every statement stands on its own."""

from __future__ import annotations

from rankloom.functions import prompts

_BLANK = r"[\s\p{Z}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


_DOCS = f"""docs AS (SELECT doc_id, arg_max({_strip("coalesce(title,'') || ' ' || coalesce(text,'')")}, pos) AS text, min(pos) AS pos
  FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id)"""
_ASKED = """asked AS (SELECT qid, text, seed_doc_ids, quality, CAST(substr(qid, 2) AS BIGINT) AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY created_at DESC, text DESC NULLS LAST) AS _r FROM queries WHERE qid IS NOT NULL) WHERE _r = 1)"""
_SEARCH = "search AS (SELECT * FROM asked WHERE pos % 50 = 0 AND text IS NOT NULL)"


def _named(t: str) -> str:
    return f"{t}_n AS (SELECT * REPLACE ({_strip('model_a')} AS model_a, {_strip('model_b')} AS model_b) FROM {t})"


_OK = "score_a IS NOT NULL AND coalesce(list_bool_and(list_transform(parsed_ok, lambda x: coalesce(x, false))), true)"
_USABLE = _named("verdicts") + f", v AS (SELECT * FROM verdicts_n WHERE {_OK})"
_PANEL = _named("panel") + f", pv AS (SELECT * FROM panel_n WHERE {_OK})"
_WINS = "wins AS (SELECT i, j, sum(w) AS w FROM (SELECT model_a AS i, model_b AS j, score_a AS w FROM v UNION ALL SELECT model_b, model_a, 1 - score_a FROM v) GROUP BY i, j)"
_TOK = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
_OKAY = "coalesce(length(text) BETWEEN 15 AND 240 AND length(text) - length(replace(text, ' ', '')) >= 2 AND regexp_matches(text, '[A-Za-z]'), false)"
_TOKENS = f"""toks AS (SELECT doc_id, {_TOK} AS t FROM docs), post AS (SELECT doc_id, token, count(*) AS tf, any_value(len) AS len FROM
  (SELECT doc_id, len(t) AS len, unnest(t) AS token FROM toks) GROUP BY doc_id, token),
  dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
  qt AS (SELECT DISTINCT qid, unnest({_TOK}) AS token FROM search)"""
_TOP = "SELECT qid, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10"
_HITS = """hits AS (SELECT model, qid, doc_id, max(score) AS score, min(p) AS pos FROM (
  SELECT model, qid, unnest(doc_ids) AS doc_id, unnest(scores) AS score, unnest(range(len(doc_ids))) AS p FROM ranked)
  WHERE doc_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY model, qid, doc_id)"""
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, pos, doc_id) AS rank FROM hits) WHERE rank <= 10)"
_MODELS = "models AS (SELECT DISTINCT model FROM ranked)"
_PAIRS = "pairs AS (SELECT CAST(row_number() OVER (ORDER BY a.model, b.model) - 1 AS INTEGER) AS pair, a.model AS model_a, b.model AS model_b FROM models a JOIN models b ON a.model < b.model)"


def _lists(asked: str) -> str:
    return f"""lists AS (SELECT m.model, q.qid, q.text AS query, coalesce(l.ids, []) AS ids, coalesce(l.texts, []) AS texts FROM {asked} q CROSS JOIN models m
  LEFT JOIN (SELECT model, qid, list(doc_id ORDER BY rank) AS ids, list(d.text ORDER BY rank) AS texts FROM best JOIN docs d USING (doc_id) GROUP BY model, qid) l
  ON l.model = m.model AND l.qid = q.qid)"""


_MET = f"""{_DOCS}, {_ASKED}, told AS (SELECT * FROM asked WHERE text IS NOT NULL), {_HITS}, {_BEST}, {_MODELS}, {_PAIRS}, {_lists("told")},
  met AS (SELECT p.pair, p.model_a, p.model_b, a.qid, a.query, a.ids AS ids_a, a.texts AS texts_a, b.ids AS ids_b, b.texts AS texts_b,
    (a.ids = b.ids AND a.texts = b.texts) AS same FROM pairs p JOIN lists a ON a.model = p.model_a JOIN lists b ON b.model = p.model_b AND b.qid = a.qid)"""


def _cut(t: str, n: int) -> str:
    head = f"substr({t}, 1, {n})"
    bare = rf"regexp_replace({head}, '{_BLANK}+$', '')"
    inner = rf"regexp_replace({bare}, '^{_BLANK}+', '')"
    worded = rf"CASE WHEN {bare} = '' THEN {head} WHEN NOT regexp_matches({inner}, '{_BLANK}') THEN {inner} ELSE regexp_replace({bare}, '{_BLANK}+[^\s\p{{Z}}]+$', '') END"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE (CASE WHEN instr({head}, ' ') > 0 THEN {worded} ELSE {head} END) || '...' END"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _numbered(x: str, n: int) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda t, i: '  ' || CAST(i AS VARCHAR) || '. ' || ({_cut('t', n)})), chr(10)), '')"


def _prompts(n: int) -> str:
    first, second = "CASE WHEN turn = 1 THEN texts_a ELSE texts_b END", "CASE WHEN turn = 1 THEN texts_b ELSE texts_a END"
    nl2 = "chr(10) || chr(10)"
    return f"""turns AS (SELECT *, {first} AS f1, {second} AS f2 FROM met CROSS JOIN (SELECT unnest([1, 2]) AS turn)),
  prompts AS (SELECT pair, qid, turn, same, 'Query: ' || query || {nl2} || 'System A results:' || chr(10) || {_numbered("f1", n)} || {nl2} || 'System B results:' || chr(10) || {_numbered("f2", n)} || {nl2} || 'Reply as JSON.' AS usr FROM turns)"""


def _hash(x: str) -> str:
    return f"CAST('0x' || substr(sha256('0:' || {x}), 1, 8) AS BIGINT)"


_JUDGED = f"""{_prompts(2000)}, hashed AS (SELECT *, {_hash(_lit(prompts.judge_system() + " ") + " || usr")} AS h, lower({_lit(prompts.judge_system() + " ")} || usr) LIKE '%rate the quality%' AS rated FROM prompts WHERE NOT same),
  answers AS (SELECT pair, qid, turn, CASE WHEN rated THEN 'tie' ELSE ['A', 'B', 'tie'][h % 3 + 1] END AS winner, NOT rated AS ok FROM hashed)"""
_OUT = "(CASE WHEN {0} = 'A' THEN 1.0 WHEN {0} = 'B' THEN 0.0 ELSE 0.5 END)"


def _winner(x: str) -> str:
    t = rf"lower(regexp_replace({_strip(x)}, '\.+$', ''))"
    t = _strip(f"regexp_replace({t}, '^system ', '')")
    return f"CASE {t} WHEN 'a' THEN 'A' WHEN 'b' THEN 'B' WHEN 'tie' THEN 'tie' END"


_DIAGNOSE = """coalesce(sum(len(parsed_ok)), 0)::BIGINT AS judge_calls, count(*) AS n_comparisons,
  round((count(*) - count(*) FILTER (score_a = 0.5)) / count(*), 6) AS commit_rate, round(count(*) FILTER (score_a = 0.5) / count(*), 6) AS tie_rate,
  round(sum(len(list_filter(raw, lambda w: w = 'A'))) / nullif(sum(len(list_filter(raw, lambda w: w IN ('A', 'B')))), 0), 6) AS a_first_rate,
  round(sum(len(list_filter(parsed_ok, lambda x: NOT x))) / nullif(sum(len(parsed_ok)), 0), 6) AS parse_failure_rate,
  round(count(*) FILTER (raw = ['identical']) / count(*), 6) AS identical_retrieval_rate"""


def _means(src: str, *by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"SELECT {keys}model, round(avg(s), 9) AS score FROM (SELECT {keys}model_a AS model, score_a AS s FROM {src} UNION ALL SELECT {keys}model_b, 1 - score_a FROM {src}) GROUP BY {keys}model"


_AGREE = f"{_USABLE}, {_PANEL}, g AS ({_means('v', 'task')}), t AS ({_means('pv')}), x AS (SELECT task, g.model, g.score AS g, t.score AS t FROM g JOIN t USING (model))"


def _rho(src: str) -> str:
    rank = "rank() OVER (PARTITION BY task ORDER BY {0}) + (count(*) OVER (PARTITION BY task, {0}) - 1) / 2.0"
    return f"SELECT task, count(*) AS n, round(corr(rg, rt), 6) AS rho FROM (SELECT task, {rank.format('g')} AS rg, {rank.format('t')} AS rt FROM {src}) GROUP BY task"


_COS = "list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)))"


def _dense(score: str) -> str:
    return f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), scored AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round({score}, 6) AS score
  FROM e d JOIN e q ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id) {_TOP}"""


_WRITER = prompts.WRITER_USER.split("{documents}")

SQL: dict[str, str] = {
    "corpus_scan": f"WITH {_DOCS} SELECT * FROM docs",
    "title_text_concat": f"SELECT pos, {_strip(chr(32).join(['coalesce(title,', chr(39) * 2 + ')']) + " || ' ' || coalesce(text,'')")} AS full_text FROM corpus",
    "corpus_last_wins": "SELECT doc_id, title, corpus_id, p AS pos FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id) AS p, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS r FROM corpus WHERE doc_id IS NOT NULL) WHERE r = 1",
    "query_heuristics": f"WITH {_ASKED} SELECT qid, {_OKAY} AS ok FROM asked",
    "query_quality_filter": f"WITH {_ASKED} SELECT qid, quality FROM asked WHERE coalesce(quality, 0) >= 3",
    "query_renumber_limit": f"WITH {_ASKED}, g AS (SELECT text, row_number() OVER (ORDER BY pos) - 1 AS pos FROM asked WHERE {_OKAY} AND coalesce(quality, 0) >= 3) SELECT 'q' || pos AS qid, text, pos FROM g WHERE pos < 100",
    "token_sets": f"WITH {_DOCS}, s AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS t FROM docs) SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, coalesce(array_to_string(t, ' '), '') AS tokens FROM s",
    "jaccard_pairs": f"""WITH {_DOCS}, {_ASKED}, m AS (SELECT DISTINCT qid, text AS q, unnest(seed_doc_ids) AS doc_id FROM asked),
  s AS (SELECT qid, doc_id, list_distinct({_TOK.replace("text", "q")}) AS a, list_distinct({_TOK}) AS b FROM m JOIN docs USING (doc_id) WHERE q IS NOT NULL)
  SELECT qid, doc_id, round(len(list_intersect(a, b)) / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 6) AS jaccard FROM s""",
    "near_dup_edges": f"""WITH {_ASKED}, n AS (SELECT list_sort(list_distinct({_TOK})) AS t, min(pos) AS p FROM asked WHERE text IS NOT NULL GROUP BY 1 HAVING len(t) > 0)
  SELECT a.p AS early, b.p AS late FROM n a JOIN n b ON a.p < b.p AND len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9""",
    "truncate_words": f"SELECT doc_id, {_cut('text', 60)} AS head, CAST(length({_cut('text', 2000)}) AS INTEGER) AS shown FROM documents WHERE text IS NOT NULL",
    "slugs": r"SELECT DISTINCT model, regexp_replace(model, '[^A-Za-z0-9._-]', '_', 'g') AS slug, regexp_replace(regexp_replace(split_part(model, '/', -1), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS short FROM (SELECT model_a AS model FROM verdicts UNION ALL SELECT model_b FROM verdicts)",
    "identity_hash": "SELECT line_no, substr(sha256(judge || '|' || query_set || '|' || model_a || '|' || model_b), 1, 12) AS id FROM verdicts",
    "writer_prompt": f"""WITH {_DOCS}, {_ASKED}, s AS (SELECT qid, unnest(seed_doc_ids) AS doc_id, unnest(range(len(seed_doc_ids))) AS place FROM asked),
  l AS (SELECT qid, list(d.text ORDER BY place, d.text) AS t FROM s JOIN docs d USING (doc_id) GROUP BY qid),
  u AS (SELECT qid, {_lit(_WRITER[0])} || array_to_string(list_transform(t, lambda x, i: '[' || CAST(i AS VARCHAR) || '] ' || substr(x, 1, 600)), chr(10) || chr(10)) || {_lit(_WRITER[1])} AS usr FROM l),
  p AS (SELECT *, {_lit(prompts.writer_system() + " ")} || usr AS whole FROM u),
  w AS (SELECT *, {_hash("whole")} AS h, array_to_string(regexp_extract_all(CASE WHEN instr(whole, '[1] ') > 0 THEN substr(whole, instr(whole, '[1] ') + 4) ELSE whole END, '[A-Za-z]{{4,}}')[1:6], ' ') AS words FROM p)
  SELECT qid, sha256(usr) AS prompt_hash, CASE WHEN lower(whole) LIKE '%rate the quality%' OR lower(whole) LIKE '%system a%' THEN NULL ELSE 'what is known about ' || CASE WHEN words <> '' THEN words ELSE 'topic ' || CAST(h % 1000 AS VARCHAR) END END AS written FROM w""",
    "mock_quality": f"WITH {_ASKED} SELECT qid, CAST({_hash(_lit(prompts.RATER_SYSTEM + ' Query: ') + ' || text || chr(10) || ' + _lit('Reply as JSON.'))} % 5 + 1 AS INTEGER) AS quality FROM asked WHERE text IS NOT NULL",
    "extract_json": "SELECT event_id, CAST(len(json_keys(props)) AS INTEGER) AS n, array_to_string(list_transform(list_sort(json_keys(props)), lambda k: k || '=' || json_extract_string(props, k)), ';') AS members FROM events",
    "bm25_topk": f"""WITH {_DOCS}, {_ASKED}, {_SEARCH}, {_TOKENS}, n AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
  scored AS (SELECT qid, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))), 6) AS score
    FROM post JOIN dfs USING (token) JOIN qt USING (token) CROSS JOIN n GROUP BY qid, doc_id) {_TOP}""",
    "tfidf_topk": f"""WITH {_DOCS}, {_ASKED}, {_SEARCH}, {_TOKENS}, n AS (SELECT count(*) AS n_docs FROM docs), idf AS (SELECT token, ln(n_docs / df) AS idf FROM dfs CROSS JOIN n),
  w AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS w FROM post JOIN idf USING (token)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
  qw AS (SELECT qid, token, idf FROM qt JOIN idf USING (token)), qn AS (SELECT qid, sqrt(sum(idf * idf)) AS qnorm FROM qw GROUP BY qid),
  scored AS (SELECT qid, doc_id, round(sum(w * idf / qnorm) / any_value(norm), 6) AS score FROM w JOIN qw USING (token) JOIN qn USING (qid) JOIN norm USING (doc_id) WHERE norm > 0 AND qnorm > 0 GROUP BY qid, doc_id) {_TOP}""",
    "jaccard_topk": f"""WITH {_DOCS}, {_ASKED}, {_SEARCH}, {_TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM post GROUP BY doc_id), m AS (SELECT qid, count(*) AS m FROM qt GROUP BY qid),
  x AS (SELECT qid, doc_id, count(*) AS x FROM post JOIN qt USING (token) GROUP BY qid, doc_id), scored AS (SELECT qid, doc_id, round(x / (n + m - x), 6) AS score FROM x JOIN n USING (doc_id) JOIN m USING (qid)) {_TOP}""",
    "dense_cos_topk": _dense(_COS),
    "dense_dot_topk": _dense("list_dot_product(q.v, d.v)"),
    "dense_l2_topk": _dense("-list_distance(q.v, d.v)"),
    "dense_trunc_16_topk": _dense("list_dot_product(q.v[1:16], d.v[1:16])"),
    "dense_sign_topk": _dense("CAST(len(list_filter(list_zip(q.v, d.v), lambda p: (p[1] >= 0) = (p[2] >= 0))) AS DOUBLE)"),
    "self_match_drop": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), scored AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, round({_COS}, 6) AS score FROM e d JOIN e q ON q.vec_id % 50 = 0)
  SELECT qid, doc_id, score FROM ({_TOP}) WHERE qid <> doc_id""",
    "ranked_lists": f"""WITH {_DOCS}, {_ASKED}, {_HITS}, {_BEST}, {_MODELS}, {_lists("asked")} SELECT model, qid, coalesce(array_to_string(ids, ','), '') AS docs, CAST(coalesce(list_sum(list_transform(texts, lambda t: length(t))), 0) AS INTEGER) AS chars FROM lists""",
    "missing_hits_left_join": f"WITH {_DOCS}, {_ASKED}, {_HITS}, {_BEST}, {_MODELS}, {_lists('asked')} SELECT model, count(*) AS n, count(*) FILTER (len(ids) = 0) AS empty FROM lists GROUP BY model",
    "hits_outside_corpus": f"WITH {_DOCS}, {_HITS}, {_BEST} SELECT model, count(*) AS n FROM best WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE length(text) >= 300) GROUP BY model",
    "ndcg_at_10": f"""WITH {_ASKED}, {_HITS}, q AS (SELECT DISTINCT qid, unnest(seed_doc_ids) AS doc_id FROM asked), lab AS (SELECT * FROM q WHERE doc_id IS NOT NULL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 10),
  ideal AS (SELECT qid, sum(1 / log2(rank + 1)) AS best FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank FROM lab) WHERE rank <= 10 GROUP BY qid),
  got AS (SELECT model, qid, sum(1 / log2(rank + 1)) AS dcg FROM best JOIN lab USING (qid, doc_id) GROUP BY model, qid)
  SELECT m.model, round(avg(coalesce(dcg, 0) / ideal.best), 6) AS ndcg FROM ideal CROSS JOIN (SELECT DISTINCT model FROM hits) m LEFT JOIN got ON got.model = m.model AND got.qid = ideal.qid GROUP BY m.model""",
    "precision_at_10": f"""WITH {_ASKED}, {_HITS}, q AS (SELECT DISTINCT qid, unnest(seed_doc_ids) AS doc_id FROM asked), lab AS (SELECT * FROM q WHERE doc_id IS NOT NULL),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, qid ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 10),
  got AS (SELECT model, qid, count(*) / 10 AS p FROM best JOIN lab USING (qid, doc_id) GROUP BY model, qid)
  SELECT m.model, round(avg(coalesce(p, 0)), 6) AS precision FROM (SELECT DISTINCT qid FROM lab) l CROSS JOIN (SELECT DISTINCT model FROM hits) m LEFT JOIN got ON got.model = m.model AND got.qid = l.qid GROUP BY m.model""",
    "model_pairs": f"WITH {_MODELS}, {_PAIRS} SELECT * FROM pairs",
    "pairs_by_query": "WITH l AS (SELECT DISTINCT model, qid FROM ranked) SELECT a.model AS model_a, b.model AS model_b, count(*) AS n FROM l a JOIN l b ON a.qid = b.qid AND a.model < b.model GROUP BY 1, 2",
    "identical_retrieval": f"WITH {_MET} SELECT model_a, model_b, count(*) AS n, count(*) FILTER (same) AS same FROM met GROUP BY 1, 2",
    "judge_prompt": f"WITH {_MET}, {_prompts(2000)} SELECT pair, qid, CAST(turn AS INTEGER) AS turn, sha256(usr) AS prompt_hash, CAST(length(usr) AS INTEGER) AS n_chars FROM prompts",
    "mock_judge_raw": f"WITH {_MET}, {_JUDGED} SELECT pair, qid, CAST(turn AS INTEGER) AS turn, winner, ok FROM answers",
    "judged_verdicts": f"""WITH {_MET}, {_JUDGED}, t AS (SELECT pair, qid, max(winner) FILTER (turn = 1) AS w1, max(winner) FILTER (turn = 2) AS w2, count(*) FILTER (ok) AS n FROM answers GROUP BY 1, 2)
  SELECT met.qid, model_a, model_b, CASE WHEN same THEN 0.5 ELSE CAST(({_OUT.format("w1")} + 1 - {_OUT.format("w2")}) / 2 AS DOUBLE) END AS score_a, CASE WHEN same THEN 'identical' ELSE w1 || ',' || w2 END AS raw,
  CASE WHEN same THEN {_lit(prompts.IDENTICAL_REASON)} ELSE 'mock | mock' END AS reasoning, CAST(CASE WHEN same THEN 0 ELSE 2 END AS INTEGER) AS orders FROM met LEFT JOIN t ON t.pair = met.pair AND t.qid = met.qid""",
    "winner_normalise": f"SELECT said, {_winner('said')} AS winner, count(*) AS n FROM (SELECT unnest(raw) AS said FROM verdicts) GROUP BY 1, 2",
    "verdict_scores": f"WITH w AS (SELECT line_no, {_winner('raw[1]')} AS w1, {_winner('raw[2]')} AS w2 FROM verdicts WHERE len(raw) = 2) SELECT line_no, CAST(({_OUT.format('w1')} + 1 - {_OUT.format('w2')}) / 2 AS DOUBLE) AS score, w1 IS NOT NULL AS ok_1, w2 IS NOT NULL AS ok_2 FROM w",
    "reasons_joined": "SELECT line_no, coalesce(array_to_string(list_filter(string_split(coalesce(reasoning, ''), ' | '), lambda r: r <> ''), ' | '), '') AS reason FROM verdicts",
    "verdict_last_wins": f"WITH {_named('verdicts')} SELECT query_set, qid, judge, model_a, model_b, line_no, score_a FROM (SELECT *, row_number() OVER (PARTITION BY query_set, qid, judge, model_a, model_b ORDER BY line_no DESC) AS r FROM verdicts_n) WHERE r = 1",
    "verdict_todo_anti": f"WITH {_named('verdicts')}, {_named('panel')} SELECT DISTINCT qid, model_a, model_b FROM panel_n p WHERE NOT EXISTS (SELECT 1 FROM verdicts_n v WHERE v.qid = p.qid AND v.model_a = p.model_a AND v.model_b = p.model_b)",
    "verdict_union": f"""WITH {_named("verdicts")}, {_named("panel")}, a AS (SELECT 1 AS o, qid, model_a, model_b, arg_max(coalesce(score_a, -1), line_no) AS s FROM verdicts_n GROUP BY ALL),
  b AS (SELECT 2 AS o, qid, model_a, model_b, arg_max(coalesce(score_a, -1), line_no) AS s FROM panel_n GROUP BY ALL), u AS (SELECT qid, model_a, model_b, arg_max(s, o) AS s FROM (FROM a UNION ALL FROM b) GROUP BY ALL)
  SELECT model_a, model_b, count(*) AS n, round(avg(nullif(s, -1)), 6) AS mean_score FROM u GROUP BY 1, 2""",
    "judge_guard_counts": f"""WITH {_named("verdicts")}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_a, model_b ORDER BY line_no) AS r FROM verdicts_n) WHERE r <= 30)
  SELECT model_a || '|' || model_b AS pair, count(*) AS done, count(*) FILTER (len(parsed_ok) > 0 AND NOT list_bool_or(parsed_ok)) AS failed, count(*) FILTER (raw = ['identical']) AS identical FROM e GROUP BY 1""",
    "judge_diagnostics": f"SELECT judge, {_DIAGNOSE} FROM verdicts GROUP BY judge",
    "judge_diagnostics_total": f"SELECT {_DIAGNOSE} FROM verdicts",
    "model_names": f"WITH {_named('verdicts')} SELECT model_a AS model FROM verdicts_n UNION SELECT model_b FROM verdicts_n",
    "win_matrix": f"WITH {_USABLE}, {_WINS} SELECT i, j, round(w, 6) AS w FROM wins",
    "win_loss_tie": f"WITH {_USABLE}, s AS (SELECT model_a AS model, score_a AS s FROM v UNION ALL SELECT model_b, 1 - score_a FROM v) SELECT model, CAST(count(*) FILTER (s > 0.5) AS DOUBLE) AS wins, CAST(count(*) FILTER (s < 0.5) AS DOUBLE) AS losses, CAST(count(*) FILTER (s = 0.5) AS DOUBLE) AS ties, CAST(count(*) AS INTEGER) AS n FROM s GROUP BY model",
    "bt_rating_2": f"WITH {_USABLE}, {_WINS} SELECT a.i, a.j, round(1000 + 200 * log10((a.w + 0.1) / (b.w + 0.1)), 6) AS rating FROM wins a JOIN wins b ON a.i = b.j AND a.j = b.i",
    "percentile_ci": "SELECT lang, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.025), 6) AS ci_low, round(quantile_cont(CAST(n_chars AS DOUBLE), 0.975), 6) AS ci_high FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "agreement_join": f"WITH {_AGREE} SELECT model, task, g, t FROM x",
    "spearman": f"WITH {_AGREE} {_rho('x')}",
    "kendall": f"WITH {_AGREE}, s AS (SELECT a.task, sign(a.g - b.g) AS x, sign(a.t - b.t) AS y FROM x a JOIN x b ON a.task = b.task AND a.model < b.model) SELECT task, round(sum(x * y) / nullif(sqrt(sum(abs(x)) * sum(abs(y))), 0), 6) AS tau FROM s GROUP BY task",
    "tau_ap": f"WITH {_AGREE}, p AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY t DESC, model) AS i FROM x), s AS (SELECT b.task, b.i, avg(CASE WHEN a.g > b.g THEN 1.0 ELSE 0.0 END) AS s FROM p a JOIN p b ON a.task = b.task AND a.i < b.i GROUP BY 1, 2) SELECT task, round(2 * avg(s) - 1, 6) AS tau_ap FROM s GROUP BY task",
    "spearman_top10": f"WITH {_AGREE}, p AS (SELECT *, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task ORDER BY t DESC, model) AS i FROM x), y AS (SELECT * FROM p WHERE n >= 12 AND i <= 10) {_rho('y')}",
    "official_score_pick": f"WITH {_USABLE}, s AS ({_means('v', 'task', 'judge')}), pin AS (SELECT model, min(judge) AS pin FROM s GROUP BY model) SELECT model, task, revision, score FROM (SELECT model, task, judge AS revision, score, row_number() OVER (PARTITION BY model, task ORDER BY (judge <> pin), judge DESC) AS r FROM s JOIN pin USING (model)) WHERE r = 1",
    "truth_assembly": f"""WITH {_USABLE}, {_PANEL}, s AS ({_means("v", "task", "judge")}), pin AS (SELECT model, min(judge) AS pin FROM s GROUP BY model),
  f AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY model, task ORDER BY (judge <> pin), judge DESC) AS r FROM s JOIN pin USING (model)) WHERE r = 1),
  p AS ({_means("pv")}), m AS (SELECT model_a AS model FROM verdicts_n UNION SELECT model_b FROM verdicts_n), a AS (SELECT * FROM m CROSS JOIN (SELECT DISTINCT task FROM s))
  SELECT a.task, a.model, round(coalesce(f.score, p.score) * 100, 2) AS score, CASE WHEN f.score IS NOT NULL THEN f.judge ELSE 'r1' END AS revision, f.score IS NOT NULL AS official FROM a LEFT JOIN f ON f.model = a.model AND f.task = a.task
  LEFT JOIN p ON p.model = a.model WHERE coalesce(f.score, p.score) IS NOT NULL""",
    "leaderboard": f"WITH {_USABLE}, s AS ({_means('v')}) SELECT model AS name, score AS rating FROM s ORDER BY rating DESC, name",
    "distinct_files": "SELECT DISTINCT path FROM (SELECT 'queries/' || query_set || '.json' AS path FROM verdicts UNION ALL SELECT 'verdicts/' || task || '/' || regexp_replace(judge, '[^A-Za-z0-9._-]', '_', 'g') FROM verdicts) ORDER BY path",
    "windowed_outcomes": "SELECT date_trunc('day', judged_at)::TIMESTAMP AS day, judge, count(*) AS n, count(*) FILTER (score_a = 0.5) AS ties, count(*) FILTER (list_bool_or(list_transform(parsed_ok, lambda x: NOT x))) AS failed FROM verdicts GROUP BY 1, 2",
    "stream_win_matrix": f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_set, qid, judge, model_a, model_b ORDER BY line_no DESC) AS r FROM verdicts) WHERE r = 1), v AS (SELECT * FROM l WHERE {_OK}), {_WINS} SELECT i, j, round(w, 6) AS w FROM wins""",
}
# One recursion step is one model's update; the sweep ends with the last model, where strengths are scaled.
SQL["bt_rating_all"] = f"""WITH RECURSIVE {_USABLE}, {_WINS}, names AS (SELECT model, row_number() OVER (ORDER BY model) AS i FROM (SELECT DISTINCT i AS model FROM wins)),
  full_w AS (SELECT a.i, b.i AS j, coalesce(w, 0) + 0.1 AS w FROM names a JOIN names b ON a.i <> b.i LEFT JOIN wins ON wins.i = a.model AND wins.j = b.model),
  cells AS (SELECT a.i, b.i AS j, coalesce(x.w, 0) AS w, coalesce(x.w, 0) + coalesce(y.w, 0) AS g FROM names a CROSS JOIN names b LEFT JOIN full_w x ON x.i = a.i AND x.j = b.i LEFT JOIN full_w y ON y.i = b.i AND y.j = a.i),
  per AS (SELECT i, sum(w) AS won, list(g ORDER BY j) AS met FROM cells GROUP BY i), c AS (SELECT count(*) AS n, list(won ORDER BY i) AS won, list(met ORDER BY i) AS met FROM per),
  s AS (SELECT 0 AS k, list_transform(won, lambda x: 1.0::DOUBLE) AS p, list_transform(won, lambda x: 1.0::DOUBLE) AS old, false AS done FROM c
    UNION ALL SELECT k + 1, q, CASE WHEN i = n THEN q ELSE old END, i = n AND list_max(list_transform(q, lambda x, j: abs(x - old[j]))) < 1e-9 FROM (
      SELECT k, n, i, old, CASE WHEN i = n THEN list_transform(u, lambda x: x / exp(list_avg(list_transform(u, lambda y: ln(greatest(y, 1e-12)))))) ELSE u END AS q FROM (
        SELECT k, n, i, old, list_transform(p, lambda x, j: CASE WHEN j = i THEN won[i] / load ELSE x END) AS u FROM (
          SELECT s.k, c.n, s.k % c.n + 1 AS i, s.p, s.old, c.won, list_sum(list_transform(s.p, lambda y, l: CASE WHEN l = s.k % c.n + 1 THEN 0 ELSE c.met[s.k % c.n + 1][l] / (s.p[s.k % c.n + 1] + y) END)) AS load
          FROM s CROSS JOIN c WHERE NOT s.done AND s.k < 200 * c.n)))),
  last AS (SELECT arg_max(p, k) AS p FROM s), r AS (SELECT model, 400 * log10(greatest(p[i], 1e-12)) AS r FROM names CROSS JOIN last)
  SELECT model, round(r - avg(r) OVER () + 1000, 6) AS rating FROM r"""
_WLT = SQL["win_loss_tie"]
SQL["record_explode"] = f"SELECT 'arena' AS task, 'mock' AS judge, 'own' AS arm, CAST(100 AS BIGINT) AS n_queries, model, 'r1' AS revision, wins, losses, ties, CAST(n AS BIGINT) AS n FROM ({_WLT})"


# Every query that is similar to an earlier one is looked at in order: gone if one of these is not gone.
SQL["greedy_dedup"] = f"""WITH RECURSIVE {_ASKED}, sets AS MATERIALIZED (SELECT qid, pos, list_sort(list_distinct({_TOK})) AS t FROM asked WHERE text IS NOT NULL),
  nodes AS MATERIALIZED (SELECT t, min(pos) AS p FROM sets WHERE len(t) > 0 GROUP BY t),
  edges AS MATERIALIZED (SELECT a.p AS early, b.p AS late FROM nodes a JOIN nodes b ON a.p < b.p AND len(list_intersect(a.t, b.t)) >= 0.8 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) - 1e-9),
  line AS MATERIALIZED (SELECT late AS p, list(early) AS early, row_number() OVER (ORDER BY late) AS i FROM edges GROUP BY late),
  walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone UNION ALL
    SELECT l.i, CASE WHEN len(list_filter(early, lambda e: NOT list_contains(gone, e))) > 0 THEN list_append(gone, p) ELSE gone END FROM walk w JOIN line l ON l.i = w.i + 1),
  last AS (SELECT unnest(arg_max(gone, i)) AS pos FROM walk) SELECT qid, pos FROM sets WHERE len(t) = 0 OR (pos IN (SELECT p FROM nodes) AND pos NOT IN (SELECT pos FROM last))"""
_STRAY = r"[\r\n\x0B\f\x{85}\x{2028}\x{2029}]"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_set, qid, judge, model_a, model_b ORDER BY line_no DESC) AS r FROM verdicts_n) WHERE r = 1)"
_TASKS = f"""sides AS (SELECT task, model_a AS m, score_a AS s FROM v UNION ALL SELECT task, model_b, 1 - score_a FROM v),
  t AS (SELECT task, m AS model, round(1000 * avg(s), 3) AS rating, CAST(count(*) FILTER (s > 0.5) AS DOUBLE) AS wins, CAST(count(*) FILTER (s < 0.5) AS DOUBLE) AS losses, CAST(count(*) FILTER (s = 0.5) AS DOUBLE) AS ties, count(*) AS n FROM sides GROUP BY task, m)"""
_FILES = "SELECT DISTINCT regexp_replace(judge, '[^A-Za-z0-9._-]', '_', 'g') || '/' || query_set AS path, sha256(task) AS sha FROM {0}"
SQL |= {
    "jsonl_corpus": f"WITH {_DOCS} SELECT doc_id, text FROM docs",
    "corpus_digest": f"""WITH {_DOCS}, h AS (SELECT sha256(pos || chr(31) || doc_id || chr(31) || text) AS h FROM docs), s AS (SELECT count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS HUGEINT)) AS s{k}" for k in range(4))} FROM h)
  SELECT substr(sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3), 1, 12) AS digest FROM s""",
    "own_queries_txt": f"WITH {_ASKED}, l AS (SELECT {_strip(f"regexp_replace(text, '{_STRAY}', ' ', 'g')")} AS text FROM asked WHERE text IS NOT NULL) SELECT text, count(*) AS n FROM l WHERE text <> '' GROUP BY text",
    "own_queries_jsonl": f"WITH {_ASKED} SELECT qid, text FROM asked WHERE text IS NOT NULL",
    "query_set_file": f"""WITH {_ASKED}, g AS (SELECT text, quality, seed_doc_ids, row_number() OVER (ORDER BY pos) - 1 AS p FROM asked WHERE {_OKAY} AND coalesce(quality, 0) >= 3)
  SELECT 'q' || p AS qid, text, quality, CAST(coalesce(len(seed_doc_ids), 0) AS INTEGER) AS n_seeds, CAST(160 AS INTEGER) AS n_generated FROM g WHERE p < 100""",
    "prediction_file_hits": f"WITH {_ASKED}, {_SEARCH}, {_HITS} SELECT model, qid, doc_id, score FROM hits WHERE model = (SELECT min(model) FROM ranked) AND qid IN (SELECT qid FROM search)",
    "verdict_log_appends": f"WITH {_named('verdicts')}, l AS {_LAST} SELECT query_set, qid, judge, model_a, model_b, score_a, coalesce(array_to_string(list_transform(raw, lambda x: coalesce(x, '-')), ','), '') AS raw, CAST(coalesce(len(parsed_ok), 0) AS INTEGER) AS orders FROM l",
    "corrupt_verdict_lines": "SELECT coalesce(judge, '') AS judge, count(*) AS n, round(sum(score_a), 2) AS score FROM verdicts GROUP BY 1",
    "record_files": f"WITH {_USABLE}, {_TASKS} SELECT task, 'own' AS arm, model, 'r1' AS revision, rating, wins, losses, ties, n, CAST(0.5 AS DOUBLE) AS ndcg_at_10 FROM t",
    "leaderboard_text": f"""WITH {_USABLE}, {_TASKS}, a AS (SELECT model, sum(rating) AS rating, sum(wins) AS w, sum(losses) AS l, sum(ties) AS d, CAST(sum(n) AS DOUBLE) AS n FROM t GROUP BY model),
  b AS (SELECT row_number() OVER (ORDER BY rating DESC, model) AS i, *, count(*) OVER () AS m FROM a), x AS (SELECT i + 2 AS line, printf('%-5d%-38s%8.0f%7.0f%5.0f%5.0f%5.0f', i, substr(split_part(model, '/', -1), 1, 36), rating, n / 2, w, l, d) AS printed FROM b
  UNION ALL SELECT unnest([0, 1, 2]), unnest([repeat('=', 78), 'Rank ' || rpad('Model', 38, ' ') || '  Rating    CI±    W    L    T', repeat('-', 78)]) UNION ALL SELECT count(*) + 3, repeat('=', 78) FROM a) SELECT CAST(line AS INTEGER) AS line, printed FROM x""",
    "extract_json_shapes": """SELECT event_id, CAST(shape AS INTEGER) AS shape, CASE shape WHEN 0 THEN '' WHEN 1 THEN 'outer' WHEN 4 THEN 'last' ELSE array_to_string(list_sort(json_keys(props)), ',') END AS members FROM events CROSS JOIN (SELECT unnest(range(5)) AS shape)""",
    "quality_shapes": f"""WITH {_ASKED} SELECT qid, CAST(shape AS INTEGER) AS shape, CAST(CASE WHEN shape <= 2 THEN quality WHEN shape = 4 AND quality >= 0 THEN -quality ELSE 3 END AS INTEGER) AS quality
  FROM asked CROSS JOIN (SELECT unnest(range(6)) AS shape) WHERE quality IS NOT NULL""",
    "rated_queries": SQL["mock_quality"].replace(" AS quality FROM", " AS quality, CAST(0 AS INTEGER) AS unreadable FROM"),
    "ci_half_width": f"SELECT lang, round((quantile_cont(CAST(n_chars AS DOUBLE), 0.975) - quantile_cont(CAST(n_chars AS DOUBLE), 0.025)) / 2, 6) AS half FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "requested_verdicts": f"""WITH {_named("verdicts")}, {_named("panel")}, l AS (SELECT qid, model_a, model_b, score_a FROM (SELECT *, row_number() OVER (PARTITION BY qid, model_a, model_b ORDER BY line_no DESC) AS r FROM verdicts_n) WHERE r = 1)
  SELECT qid, model_a, model_b, model_a || '|' || model_b AS pair, score_a FROM l JOIN (SELECT DISTINCT qid, model_a, model_b FROM panel_n) USING (qid, model_a, model_b)""",
    "new_files": f"{_FILES.format('panel')} EXCEPT {_FILES.format('verdicts')}",
    "missing_files": f"SELECT path FROM ({_FILES.format('panel')}) EXCEPT SELECT path FROM ({_FILES.format('verdicts')})",
    "strict_lists": f"""WITH {_DOCS.replace("docs AS", "all_docs AS", 1)}, docs AS (SELECT * FROM all_docs WHERE length(text) >= 300), {_ASKED}, {_HITS.replace("hits AS", "all_hits AS", 1)}, hits AS (SELECT * FROM all_hits WHERE doc_id IN (SELECT doc_id FROM docs)),
  {_BEST}, {_MODELS}, {_lists("asked")} SELECT model, qid, coalesce(array_to_string(ids, ','), '') AS docs FROM lists""",
    "logs_union": "SELECT judge, count(*) AS n, count(logged_at) AS logged FROM (SELECT judge, logged_at FROM verdicts UNION ALL SELECT judge, NULL FROM panel) GROUP BY judge",
    "maxsim_topk": _dense("list_sum(list_transform(range(4), lambda i: list_max(list_transform(range(4), lambda j: list_dot_product(q.v[16 * i + 1:16 * i + 16], d.v[16 * j + 1:16 * j + 16])))))"),
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
