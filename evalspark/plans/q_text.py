"""Queries: prompt job and response job."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.values import values

from .. import catalog as C
from ..functions.hashing import seeded_hash
from ..functions.text import EFFORT_ORDER, fmt_value, row_to_text
from ..operators import prompts as PR
from ..operators import responses as RS
from ..operators import splits as S
from ..session import materialize, small_side
from .oracles import CTES, H, cte, with_ctes
from .q_splits import _quota_sql
from .registry import query

FEATURES = [("x1", True), ("x2", True), ("grp", False)]
BATCH = 20
N_SHOT = 10


def lit(s: str) -> str:
    """A SQL string literal; newlines become chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def fmt_sql(v: str) -> str:
    return (f"CASE WHEN {v} IS NULL OR isnan({v}) THEN '?' WHEN {v} = floor({v}) THEN printf('%.0f', {v} + 0.0) "
            f"ELSE regexp_replace(regexp_replace(printf('%.4g', {v}), '(\\.\\d*?)0+(e|$)', '\\1\\2'), "
            f"'\\.(e|$)', '\\1') END")


ROWTEXT_SQL = f"'x1=' || {fmt_sql('x1')} || ', x2=' || {fmt_sql('x2')} || ', grp=' || coalesce(grp, '?')"

# ------------------------------------------------------------------ shared fact tables (SQL)
if "fewshot_train" not in CTES:
    cte("fewshot_train", ("clf_parts",), f"""
SELECT r.seed, r.key, r.row_id, r.target, r.x1, r.x2, r.grp FROM (
  SELECT *, row_number() OVER (PARTITION BY key, seed, target ORDER BY {H('seed', 'row_id')}, row_id) AS rn
  FROM clf_parts WHERE part = 'train') r
JOIN ({_quota_sql("(SELECT key || ':' || CAST(seed AS VARCHAR) AS key, target FROM clf_parts WHERE part = 'train')", N_SHOT)}) q
  ON q.key = r.key || ':' || CAST(r.seed AS VARCHAR) AND q.target = r.target
WHERE r.rn <= q.quota""")
    cte("codec", ("fewshot_train",), """
SELECT seed, key, cls, 'C' || CAST(dense_rank() OVER (PARTITION BY seed, key ORDER BY cls) - 1 AS VARCHAR) AS token,
       CAST(dense_rank() OVER (PARTITION BY seed, key ORDER BY cls) - 1 AS INTEGER) AS cls_idx
FROM (SELECT DISTINCT seed, key, target AS cls FROM fewshot_train)""")
    cte("test_chunks", ("clf_parts",), f"""
SELECT seed, key, row_id, target, x1, x2, grp, pos, CAST(floor((pos - 1) / {BATCH}) AS INTEGER) AS chunk,
       CAST((pos - 1) % {BATCH} + 1 AS INTEGER) AS row_in_chunk
FROM (SELECT *, row_number() OVER (PARTITION BY seed, key ORDER BY {H('seed', 'row_id')}, row_id) AS pos
      FROM clf_parts WHERE part = 'test')""")
    cte("train_blocks", ("fewshot_train", "codec"), f"""
SELECT seed, key, string_agg(CAST(i AS VARCHAR) || ') ' || rowtext || ' => ' || token, chr(10) ORDER BY i) AS train_block,
       count(*) AS n_train
FROM (SELECT f.seed, f.key, c.token, {ROWTEXT_SQL} AS rowtext,
             row_number() OVER (PARTITION BY f.seed, f.key ORDER BY {H('f.seed', 'f.row_id')}, f.row_id) AS i
      FROM fewshot_train f JOIN codec c ON f.seed = c.seed AND f.key = c.key AND f.target = c.cls)
GROUP BY 1, 2""")
    msg = (f"{lit(PR.MSG_HEAD + 'x1, x2, grp.' + chr(10) + PR.MSG_CLASSES)} || cl.class_list || "
           f"{lit('.' + chr(10) + chr(10) + PR.MSG_TRAIN)} || tb.train_block || {lit(chr(10) + chr(10) + PR.MSG_TEST)} || "
           f"CAST(ch.n_rows AS VARCHAR) || {lit(PR.MSG_TEST_TAIL)} || ch.test_block || "
           f"{lit(chr(10) + chr(10) + PR.DIRECTIVE_OFF + PR.MSG_ASK + PR.FMT_PLAIN + PR.MSG_ONLY)} || cl.class_list || '.'")
    cte("requests", ("test_chunks", "train_blocks", "codec"), f"""
SELECT ch.seed, ch.key, 'ICL-0' AS model, ch.chunk, ch.n_rows, {msg} AS prompt
FROM (SELECT seed, key, chunk, count(*) AS n_rows,
             string_agg(CAST(row_in_chunk AS VARCHAR) || ') ' || {ROWTEXT_SQL}, chr(10) ORDER BY row_in_chunk) AS test_block
      FROM test_chunks GROUP BY 1, 2, 3) ch
JOIN train_blocks tb ON ch.seed = tb.seed AND ch.key = tb.key
JOIN (SELECT seed, key, string_agg(token, ', ' ORDER BY cls_idx) AS class_list FROM codec GROUP BY 1, 2) cl
  ON ch.seed = cl.seed AND ch.key = cl.key""")
    # synthesized answers: per test row a line variant chosen by md5('ans:seed:row_id')
    cte("responses", ("test_chunks", "codec"), f"""
SELECT seed, key, 'ICL-0' AS model, chunk, count(*) AS n_rows,
       coalesce(string_agg(line, chr(10) ORDER BY row_in_chunk), '') AS text
FROM (SELECT t.seed, t.key, t.chunk, t.row_in_chunk,
             CASE substr(h, 1, 1)
               WHEN '0' THEN NULL WHEN '1' THEN NULL
               WHEN '2' THEN 'Row ' || CAST(t.row_in_chunk AS VARCHAR) || ': ' || lower(coalesce(c.token, 'C9')) || ' p=0.' || pp
               WHEN '3' THEN CAST(t.row_in_chunk AS VARCHAR) || ') the answer is ' || coalesce(c.token, 'C9')
               WHEN '4' THEN '# ' || CAST(t.row_in_chunk AS VARCHAR) || '. unknown'
               ELSE 'Row ' || CAST(t.row_in_chunk AS VARCHAR) || ': ' || coalesce(c.token, 'C9') || ' p=0.' || pp END AS line
      FROM (SELECT *, md5('ans:' || CAST(seed AS VARCHAR) || ':' || CAST(row_id AS VARCHAR)) AS h,
                   lpad(CAST(CAST('0x' || substr(md5('ans:' || CAST(seed AS VARCHAR) || ':' || CAST(row_id AS VARCHAR)), 2, 2) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS pp
            FROM test_chunks) t
      LEFT JOIN codec c ON t.seed = c.seed AND t.key = c.key AND t.target = c.cls)
GROUP BY 1, 2, 3, 4""")
    cte("parsed", ("responses", "codec"), f"""
SELECT seed, key, model, chunk, idx, token, body FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, key, model, chunk, idx ORDER BY line_no) AS r2 FROM (
    SELECT l.*, c.token, row_number() OVER (PARTITION BY l.seed, l.key, l.model, l.chunk, l.line_no
             ORDER BY CASE WHEN trim(l.body) = c.token THEN 1 WHEN lower(trim(l.body)) = lower(c.token) THEN 2 ELSE 3 END,
                      length(c.token) DESC, c.token) AS r1
    FROM (SELECT seed, key, model, chunk, n_rows, i - 1 AS line_no, TRY_CAST(ia[i] AS INTEGER) AS idx, ba[i] AS body FROM (
            SELECT *, unnest(range(1, len(ia) + 1)) AS i FROM (
              SELECT *, regexp_extract_all(text, '{__import__('evalspark').functions.text.ROW_PATTERN}', 1) AS ia,
                        regexp_extract_all(text, '{__import__('evalspark').functions.text.ROW_PATTERN}', 2) AS ba
              FROM responses))) l
    JOIN codec c ON l.seed = c.seed AND l.key = c.key
    WHERE l.idx BETWEEN 1 AND l.n_rows
      AND (trim(l.body) = c.token OR lower(trim(l.body)) = lower(c.token)
           OR regexp_matches(l.body, '(?i)\\b' || c.token || '\\b')))
  WHERE r1 = 1) WHERE r2 = 1""")


# ------------------------------------------------------------------ Spark side helpers
def _fewshot(spark, d):
    parts = C.clf_parts_cached(spark, d)
    fs = S.subsample_parts(parts, n_train=N_SHOT, n_test=None)
    return materialize(fs.filter("part = 'train'"), "shots"), parts.filter("part = 'test'")


def _codec(spark, d):
    train, _ = _fewshot(spark, d)
    return PR.label_codec(train, hide_labels=True)


def _responses(spark, d):
    """Synthesized answer texts for every request chunk (same rule as the SQL above)."""
    train, test = _fewshot(spark, d)
    return *_answers(train, test), train, test


def _answers(train, test):
    codec = PR.label_codec(train, hide_labels=True)
    ch = materialize(PR.chunk_rows(test, BATCH), "chunks")
    hh = F.md5(F.concat_ws(":", F.lit("ans"), F.col("seed").cast("string"), F.col("row_id").cast("string")))
    t = ch.withColumn("h", hh).join(small_side(codec.select("seed", "key", F.col("cls").alias("target"), "token"), "codec"),
                                    ["seed", "key", "target"], "left")
    tok = F.coalesce("token", F.lit("C9"))
    i = F.col("row_in_chunk").cast("string")
    pp = F.lpad((F.conv(F.substring("h", 2, 2), 16, 10).cast("bigint") % 100).cast("string"), 2, "0")
    c0 = F.substring("h", 1, 1)
    line = (F.when(c0.isin("0", "1"), F.lit(None))
            .when(c0 == "2", F.concat(F.lit("Row "), i, F.lit(": "), F.lower(tok), F.lit(" p=0."), pp))
            .when(c0 == "3", F.concat(i, F.lit(") the answer is "), tok))
            .when(c0 == "4", F.concat(F.lit("# "), i, F.lit(". unknown")))
            .otherwise(F.concat(F.lit("Row "), i, F.lit(": "), tok, F.lit(" p=0."), pp)))
    t = t.withColumn("line", line)
    return t.groupBy("seed", "key", "chunk").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_in_chunk", "line"))),
                                 lambda s: s["line"]), "\n").alias("text")
    ).withColumn("model", F.lit("ICL-0")), ch, codec


# ------------------------------------------------------------------ L01-L10
@query("fmt_value", with_ctes(f"""
SELECT key, row_id, {fmt_sql('x1')} AS v1, {fmt_sql('x2 / 7')} AS v2, {fmt_sql('x1 * 1000')} AS v3,
       {fmt_sql('x1 / 100000')} AS v4
FROM clf_tasks""", "clf_tasks"))
def q_fmt_value(spark, d):
    t = C.clf_tasks(spark, d)
    return t.select("key", "row_id", fmt_value(F.col("x1")).alias("v1"), fmt_value(F.col("x2") / 7).alias("v2"),
                    fmt_value(F.col("x1") * 1000).alias("v3"), fmt_value(F.col("x1") / 100000).alias("v4"))


@query("row_to_text", with_ctes(f"SELECT key, row_id, {ROWTEXT_SQL} AS text FROM clf_tasks", "clf_tasks"))
def q_row_text(spark, d):
    return C.clf_tasks(spark, d).select("key", "row_id", row_to_text(FEATURES).alias("text"))


@query("label_codec", with_ctes("SELECT seed, key, cls, token FROM codec", "codec"))
def q_codec(spark, d):
    return _codec(spark, d).select("seed", "key", "cls", "token")


@query("train_block", with_ctes("SELECT seed, key, train_block, n_train FROM train_blocks", "train_blocks"))
def q_train_block(spark, d):
    train, _ = _fewshot(spark, d)
    return PR.train_block(train, FEATURES, PR.label_codec(train))


@query("majority_class", with_ctes("SELECT seed, key, majority FROM k_major", "k_major"))
def q_majority(spark, d):
    parts = C.clf_parts_cached(spark, d)
    from ..operators.predictors import majority_class
    return majority_class(parts.filter("part = 'train'"))


@query("chunk_rows", with_ctes("SELECT seed, key, row_id, chunk, row_in_chunk FROM test_chunks", "test_chunks"))
def q_chunks(spark, d):
    _, test = _fewshot(spark, d)
    return PR.chunk_rows(test, BATCH).select("seed", "key", "row_id", "chunk", "row_in_chunk")


SYS0 = lit(PR.SYSTEM_PROMPTS[0])


@query("build_requests", with_ctes(f"""
SELECT seed, key, model, chunk, n_rows, sha256(prompt) AS prompt_sha,
       CAST(floor(length({SYS0} || chr(10) || prompt) / 3.0) + 1 AS INTEGER) AS est_tokens
FROM requests""", "requests"))
def q_requests(spark, d):
    train, test = _fewshot(spark, d)
    r = PR.build_requests(train, test, FEATURES, BATCH)
    return r.select("seed", "key", "model", "chunk", "n_rows", F.sha2("prompt", 256).alias("prompt_sha"),
                    "est_tokens")


@query("prompt_variant", f"""
SELECT o_orderkey AS prompt_index, sha256(CASE o_orderkey % 6 {' '.join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(PR.SYSTEM_PROMPTS))} END) AS prompt_sha256
FROM orders""")
def q_prompt_variant(spark, d):
    o = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_index"))
    return PR.prompt_variant(o).select("prompt_index", "prompt_sha256")


WINDOWS_SQL = "(VALUES ('ICL-0', 700), ('ICL-big', 8192)) w(model, context_window)"


@query("context_skip", with_ctes(f"""
WITH one AS (SELECT r.seed, r.key, w.model, r.est_tokens AS est_input, w.context_window
             FROM (SELECT seed, key, CAST(floor(length({SYS0} || chr(10) || prompt) / 3.0) + 1 AS INTEGER) AS est_tokens
                   FROM ({CTES['requests'][1].replace('FROM test_chunks GROUP BY', 'FROM test_chunks WHERE pos = 1 GROUP BY')})) r
             CROSS JOIN {WINDOWS_SQL})
SELECT seed, key, model, est_input, 160 AS reserve, est_input + 160 AS total, context_window,
       CASE WHEN est_input + 160 > context_window THEN printf('exceeds %s context window: ~%d tokens (input ~%d + reserved output %d) > %d',
            model, est_input + 160, est_input, 160, context_window) END AS skip_reason
FROM one""", "test_chunks", "train_blocks", "codec"))
def q_context_skip(spark, d):
    train, test = _fewshot(spark, d)
    first = PR.chunk_rows(test, BATCH).filter("pos = 1").drop("pos", "chunk", "row_in_chunk")
    one = PR.build_requests(train, first, FEATURES, BATCH).drop("model")
    windows = values(spark, [("ICL-0", 700), ("ICL-big", 8192)], "model string, context_window int")
    r = one.withColumn("model", F.explode(F.array(F.lit("ICL-0"), F.lit("ICL-big"))))
    out = PR.context_skip(r, windows)
    return out.withColumn("reserve", F.col("reserve").cast("int")).withColumn("total", F.col("total").cast("int"))


@query("pack_by_budget", with_ctes(f"""
SELECT seed, key, row_id, row_tokens, CAST(cum AS BIGINT) AS cum_tokens, CAST(chunk AS INTEGER) AS chunk,
       row_tokens > 200 AS too_large, CAST(sum(row_tokens) OVER (PARTITION BY seed, key, chunk) AS BIGINT) AS chunk_tokens,
       true AS fits
FROM (SELECT *, 2 * floor((cum - 1) / 200) - CASE WHEN floor((cum - row_tokens) / 200) < floor((cum - 1) / 200) THEN 1 ELSE 0 END AS chunk
FROM (SELECT *, sum(row_tokens) OVER (PARTITION BY seed, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
      FROM (SELECT seed, key, row_id, pos, CAST(floor(length({ROWTEXT_SQL}) / 3.0) + 1 AS INTEGER) AS row_tokens FROM test_chunks)))""",
                                 "test_chunks"))
def q_pack(spark, d):
    _, test = _fewshot(spark, d)
    ch = PR.chunk_rows(test, BATCH)
    from ..functions.text import estimate_tokens
    rows = ch.select("seed", "key", "row_id", estimate_tokens(row_to_text(FEATURES)).alias("row_tokens"))
    out = PR.pack_by_budget(rows, F.lit(200))
    return out.select("seed", "key", "row_id", "row_tokens", F.col("cum_tokens").cast("long").alias("cum_tokens"),
                      "chunk", "too_large", F.sum("row_tokens").over(Window.partitionBy("seed", "key", "chunk")).alias("chunk_tokens")
                      ).withColumn("fits", F.col("too_large") | (F.col("chunk_tokens") <= 200))


# ------------------------------------------------------------------ L11-L17
@query("parse_answers", with_ctes("SELECT seed, key, model, chunk, idx, token FROM parsed", "parsed"))
def q_parse(spark, d):
    resp, _, codec, *_ = _responses(spark, d)
    return RS.parse_answers(resp, codec.select("seed", "key", "token")).select(
        "seed", "key", "model", "chunk", "idx", "token")


@query("parse_confidence", with_ctes("""
SELECT seed, key, model, chunk, idx,
       CASE WHEN v BETWEEN 0 AND 1 THEN v END AS p
FROM (SELECT *, TRY_CAST(nullif(regexp_extract(body, '(?i)p\\s*=\\s*(0*\\.\\d+|1(?:\\.0+)?|0|1)', 1), '') AS DOUBLE) AS v FROM parsed)""",
                                     "parsed"))
def q_conf(spark, d):
    resp, _, codec, *_ = _responses(spark, d)
    p = RS.parse_confidence(RS.parse_answers(resp, codec.select("seed", "key", "token")))
    return p.select("seed", "key", "model", "chunk", "idx", "p")


FALLBACK_SQL = """
SELECT t.seed, t.key, 'ICL-0' AS model, t.chunk, t.row_in_chunk, t.row_id,
       coalesce(p.token, m.token) AS token, p.token IS NULL AS unparsed
FROM test_chunks t
LEFT JOIN parsed p ON t.seed = p.seed AND t.key = p.key AND t.chunk = p.chunk AND t.row_in_chunk = p.idx
JOIN (SELECT f.seed, f.key, c.token FROM (
        SELECT seed, key, target, row_number() OVER (PARTITION BY seed, key ORDER BY count(*) DESC, target) AS r
        FROM fewshot_train GROUP BY 1, 2, 3) f
      JOIN codec c ON f.seed = c.seed AND f.key = c.key AND f.target = c.cls WHERE f.r = 1) m
  ON t.seed = m.seed AND t.key = m.key"""


def _fallback(spark, d):
    resp, ch, codec, train, test = _responses(spark, d)
    parsed = RS.parse_confidence(RS.parse_answers(resp, codec.select("seed", "key", "token")))
    from ..operators.predictors import majority_class
    maj = majority_class(train).join(codec.withColumnRenamed("cls", "majority"), ["seed", "key", "majority"]) \
        .select("seed", "key", F.col("token").alias("majority"))
    rows = ch.withColumn("model", F.lit("ICL-0")).select("seed", "key", "model", "chunk", "row_in_chunk", "row_id")
    return RS.fallback_majority(rows, parsed, maj), codec, train, test


@query("fallback_majority", with_ctes(FALLBACK_SQL, "test_chunks", "parsed", "fewshot_train", "codec"))
def q_fallback(spark, d):
    fb, *_ = _fallback(spark, d)
    return fb.select("seed", "key", "model", "chunk", "row_in_chunk", "row_id", "token", "unparsed")


STATS_SQL = f"""
SELECT s.seed, s.key, s.model, s.n_test, s.llm_unparsed, c.llm_api_calls,
       round(s.llm_unparsed / s.n_test, 9) AS llm_unparsed_frac
FROM (SELECT seed, key, model, count(*) AS n_test, count(*) FILTER (WHERE unparsed) AS llm_unparsed
      FROM ({FALLBACK_SQL}) GROUP BY 1, 2, 3) s
JOIN (SELECT seed, key, model, count(*) AS llm_api_calls FROM requests GROUP BY 1, 2, 3) c
  ON s.seed = c.seed AND s.key = c.key AND s.model = c.model"""


@query("unit_stats", with_ctes(STATS_SQL, "test_chunks", "parsed", "fewshot_train", "codec", "requests"))
def q_unit_stats(spark, d):
    fb, _, train, test = _fallback(spark, d)
    req = PR.build_requests(train, test, FEATURES, BATCH)
    return RS.unit_stats(fb, req)


@query("unparsed_ceiling", with_ctes(f"""
SELECT seed, key, model, 'fail' AS status, 'unparseable_responses' AS reason,
       printf('%d/%d test rows had no parseable class label', llm_unparsed, n_test) AS error
FROM ({STATS_SQL}) WHERE llm_unparsed / n_test > 0.2""", "test_chunks", "parsed", "fewshot_train", "codec", "requests"))
def q_ceiling(spark, d):
    fb, _, train, test = _fallback(spark, d)
    return RS.unparsed_ceiling(RS.unit_stats(fb, PR.build_requests(train, test, FEATURES, BATCH)), 0.2)


@query("proba_map", with_ctes(f"""
WITH fb AS (SELECT f.*, p.v AS p FROM ({FALLBACK_SQL}) f
            LEFT JOIN (SELECT seed, key, chunk, idx,
                              CASE WHEN v BETWEEN 0 AND 1 THEN v END AS v
                       FROM (SELECT *, TRY_CAST(nullif(regexp_extract(body, '(?i)p\\s*=\\s*(0*\\.\\d+|1(?:\\.0+)?|0|1)', 1), '') AS DOUBLE) AS v
                             FROM parsed)) p
              ON f.seed = p.seed AND f.key = p.key AND f.chunk = p.chunk AND f.row_in_chunk = p.idx),
k AS (SELECT seed, key, count(*) AS k FROM codec GROUP BY 1, 2)
SELECT fb.seed, fb.key, fb.model, fb.chunk, fb.row_id, c.cls,
       round(CASE WHEN fb.p IS NULL OR k.k < 2 THEN (CASE WHEN c.token = fb.token THEN 1.0 ELSE 0.0 END)
            WHEN c.token = fb.token THEN least(greatest(fb.p, 1.0 / k.k), 1.0)
            ELSE (1 - least(greatest(fb.p, 1.0 / k.k), 1.0)) / (k.k - 1) END, 9) AS prob
FROM fb JOIN k ON fb.seed = k.seed AND fb.key = k.key JOIN codec c ON fb.seed = c.seed AND fb.key = c.key""",
                              "test_chunks", "parsed", "fewshot_train", "codec"))
def q_proba_map(spark, d):
    fb, codec, *_ = _fallback(spark, d)
    out = RS.proba_long(fb, codec)
    return out.withColumn("prob", F.round("prob", 9))


@query("parse_free_text", f"""
SELECT conv_id, turn, i - 1 AS line_no, TRY_CAST(ia[i] AS INTEGER) AS idx, ba[i] AS body FROM (
  SELECT conv_id, turn, ia, ba, unnest(range(1, len(ia) + 1)) AS i FROM (
    SELECT conv_id, turn, regexp_extract_all(text, '{__import__('evalspark').functions.text.ROW_PATTERN}', 1) AS ia,
           regexp_extract_all(text, '{__import__('evalspark').functions.text.ROW_PATTERN}', 2) AS ba
    FROM conversations WHERE role = 'assistant'))""")
def q_free_text(spark, d):
    conv = C.table(spark, d, "conversations").filter("role = 'assistant'")
    return RS.answer_lines(conv, keys=["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("line_no").cast("bigint").alias("line_no"), "idx", "body")


@query("identity_check", """
SELECT conv_id, turn, requested, returned,
       returned = '' OR contains(returned, lower(split_part(requested, '/', -1)))
       OR contains(lower(split_part(requested, '/', -1)), returned) AS identity_ok
FROM (SELECT conv_id, turn, 'vendor/' || lower(role) || '-' || CAST(conv_id % 3 AS VARCHAR) AS requested,
             CASE WHEN turn % 4 = 0 THEN '' ELSE lower(role) || '-' || CAST(turn % 3 AS VARCHAR) || ':latest' END AS returned
      FROM conversations)""")
def q_identity(spark, d):
    c = C.table(spark, d, "conversations").select(
        "conv_id", "turn",
        F.concat(F.lit("vendor/"), F.lower("role"), F.lit("-"), (F.col("conv_id") % 3).cast("string")).alias("requested"),
        F.when(F.col("turn") % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lower("role"), F.lit("-"), (F.col("turn") % 3).cast("string"), F.lit(":latest"))).alias("returned"))
    return RS.identity_check(c)


@query("snap_level", """
WITH req AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS requested,
                    CASE conv_id % 3 WHEN 0 THEN ['low', 'high'] WHEN 1 THEN ['none', 'medium'] ELSE ['medium'] END AS supported
             FROM conversations),
lv AS (SELECT conv_id, turn, requested, s, abs(list_position(['none', 'low', 'medium', 'high'], s)
                                                - list_position(['none', 'low', 'medium', 'high'], requested)) AS dist,
              list_position(['none', 'low', 'medium', 'high'], s) AS p
       FROM (SELECT *, unnest(supported) AS s FROM req))
SELECT conv_id, turn, requested, arg_min(s, (dist, p)) AS snapped FROM lv GROUP BY 1, 2, 3""")
def q_snap(spark, d):
    c = C.table(spark, d, "conversations")
    order = F.array(*[F.lit(x) for x in EFFORT_ORDER])
    req = c.select("conv_id", "turn",
                   F.element_at(order, (F.col("turn") % 4 + 1).cast("int")).alias("requested"),
                   F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("low"), F.lit("high")))
                   .when(F.col("conv_id") % 3 == 1, F.array(F.lit("none"), F.lit("medium")))
                   .otherwise(F.array(F.lit("medium"))).alias("supported"))
    from ..operators.frames import snap_level
    return snap_level(req, "requested", "supported").select("conv_id", "turn", "requested", "snapped")


@query("match_class", with_ctes(f"""
SELECT seed, key, model, chunk, line_no, token FROM (
  SELECT l.*, c.token, row_number() OVER (PARTITION BY l.seed, l.key, l.model, l.chunk, l.line_no
           ORDER BY CASE WHEN trim(l.body) = c.token THEN 1 WHEN lower(trim(l.body)) = lower(c.token) THEN 2 ELSE 3 END,
                    length(c.token) DESC, c.token) AS r1
  FROM (SELECT seed, key, model, chunk, CAST(i - 1 AS INTEGER) AS line_no, ba[i] AS body FROM (
          SELECT *, unnest(range(1, len(ba) + 1)) AS i FROM (
            SELECT *, regexp_extract_all(text, '{__import__('evalspark').functions.text.ROW_PATTERN}', 2) AS ba
            FROM responses))) l
  JOIN codec c ON l.seed = c.seed AND l.key = c.key
  WHERE trim(l.body) = c.token OR lower(trim(l.body)) = lower(c.token)
        OR regexp_matches(l.body, '(?i)\\b' || c.token || '\\b'))
WHERE r1 = 1""", "responses", "codec"))
def q_match_class(spark, d):
    """L12 on its own: every answer line's class by tier (exact, case-insensitive, whole
    word with the longest label first), before the index checks of L11."""
    resp, _, codec, *_ = _responses(spark, d)
    lines = RS.answer_lines(resp.select("seed", "key", "model", "chunk", "text"))
    m = RS.match_class(lines, codec.select("seed", "key", "token"))
    return m.select("seed", "key", "model", "chunk", "line_no", "token")
