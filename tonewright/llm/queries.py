"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_windows, ctw, decontaminate, exact_dedup, hard_negatives, html_text, ngram_join, pii, suffix_dedup, token_count, toxicity, turn_repair

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "html")
    return html_text.extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, key=spark.conf.get("spark.tonewright.surrogate.key", "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ctw.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", ctw.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs)
    return out.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, anchor=F.col("vec_id") % 100 == 0, label=label)


OP11_SQL = """
WITH points AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM points a JOIN points b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER best::INTEGER AS rank, n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id)
QUALIFY row_number() OVER best <= 5
"""


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = F.lit("<|im_end|><|im_start|>assistant ok").alias("text")
    odd = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told)
    return chat_windows.digests(chat_windows.windows(rows.unionByName(odd)))


OP12_SQL = rf"""
WITH told AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
    SELECT *, (strlen(text) + 3) // 4 + {chat_windows.MARKS} AS tokens, row_number() OVER inside AS nth,
           {len(chat_windows.OPEN) + 1 + len(chat_windows.CLOSE)} + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
           + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars
    FROM told WINDOW inside AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sums AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) - tokens AS before, sum(tokens) OVER (PARTITION BY conv_id) AS total,
           max(CASE WHEN nth = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS held,
           max(CASE WHEN nth = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS held_chars
    FROM turns
), spans AS (
    SELECT *, greatest(({chat_windows.BUDGET - chat_windows.HISTORY} - coalesce(held, 0)) // 2, {chat_windows.LEAST}) AS width, before // width AS part, tokens > width AS wide FROM sums
), ends AS (
    SELECT *, max(before + tokens) OVER same AS over, row_number() OVER (PARTITION BY conv_id, part, wide ORDER BY nth DESC) AS back, row_number() OVER (PARTITION BY conv_id, part, wide ORDER BY nth) AS ahead
    FROM spans WINDOW same AS (PARTITION BY conv_id, part, wide)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + coalesce(sum(chars) FILTER (over < total AND over - before <= {chat_windows.HISTORY} AND back <= {chat_windows.HISTORY_TURNS} AND NOT (nth = 1 AND role = 'system')), 0)
        + coalesce(max(held_chars), 0) * (count(*) FILTER (ahead = 1) - 1))::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with one row in four damaged in one of five ways."""
    null = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null)).cast("binary")) % 20
    role, text = F.coalesce("role", null), F.coalesce("text", null)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("times"))
    return rows.withColumn("times", F.explode("times")).drop("times")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.digests(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "_conv"])


def _op13_sql() -> str:
    """Damage by CRC-32 over lists, the cheapest edits by recursion over a conversation's rows with the best (cost, audit) of each state, and the text that they give."""
    plus = lambda x, cost, edit: f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}'}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    start, system, user, assistant = (f"v[{i}]" for i in (1, 2, 3, 4))
    put_user = least(user, *[plus(x, 2, "I") for x in (start, system, assistant)])
    put_assistant = least(assistant, plus(user, 2, "I"), *[plus(x, 4, "II") for x in (start, system)])
    after_user = [(x, e) for x in ("w[1]", "w[2]", "w[4]") for e in ("K", "R")]
    when = lambda test, made: f"CASE WHEN {test} THEN {made} ELSE {{'c': 1000000000, 'a': ''}} END"
    stays, more = "fault NOT IN ('b', 'd')", "CASE WHEN fault = 't' THEN 1 ELSE 0 END"
    keep = lambda x, role: when(f"{stays} AND initial = '{role}'", plus(x, f"({more})", "K"))
    rerole = lambda x: when(stays, plus(x, f"({more}) + 2", "R"))
    steps = [
        plus("w[1]", 3, "D"),
        least(plus("w[2]", 3, "D"), keep("w[1]", "s")),
        least(plus("w[3]", 3, "D"), *[keep(x, "u") if e == "K" else rerole(x) for x, e in after_user]),
        least(plus("w[4]", 3, "D"), keep("w[3]", "a"), rerole("w[3]")),
    ]
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    at = "CASE WHEN ({} - CASE WHEN first_s THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END"
    return f"""
WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS tb),
ks AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tb[CAST((xor(c, b) & 255) + 1 AS BIGINT)]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
    FROM conversations, tb
), dm AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM ks, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), nm AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS nth, rtrim(text, {blanks}) AS solid FROM dm
), rw AS (
    SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial,
           CASE WHEN solid = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'd' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
    FROM nm
), dp AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS i, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}, {{'c': 1000000000::BIGINT, 'a': ''}}] AS v FROM rw
    UNION ALL
    SELECT conv_id, i + 1, [{", ".join(steps)}] FROM (
        SELECT dp.conv_id, i, initial, fault, [{start}, {system}, {put_user}, {put_assistant}] AS w FROM dp JOIN rw ON rw.conv_id IS NOT DISTINCT FROM dp.conv_id AND rw.nth = dp.i)
), en AS (
    SELECT conv_id, {least(start, put_assistant)} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), ed AS (
    SELECT conv_id, best.c AS cost, best.a AS audit, regexp_extract_all(best.a, 'I*[KRD]') AS parts, regexp_extract(best.a, 'I*$') AS tail FROM en
), ot AS (
    SELECT rw.*, parts[nth + 1] AS part, length(parts[nth + 1]) - 1 AS puts, right(parts[nth + 1], 1) AS edit FROM rw JOIN ed ON ed.conv_id IS NOT DISTINCT FROM rw.conv_id
), ps AS (
    SELECT *, coalesce(sum(puts + CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ot
), fs AS (
    SELECT conv_id, bool_or(done = 0 AND puts = 0 AND edit = 'K' AND initial = 's') AS first_s, sum(puts + CASE WHEN edit = 'D' THEN 0 ELSE 1 END) AS total FROM ps GROUP BY conv_id
), ln AS (
    SELECT ps.conv_id, nth AS k, j, {at.format("done + j")} || ':' AS line FROM ps JOIN fs ON fs.conv_id IS NOT DISTINCT FROM ps.conv_id, range(1, 3) r(j) WHERE j <= puts
    UNION ALL SELECT ps.conv_id, nth, 9, CASE WHEN edit = 'K' THEN role ELSE {at.format("done + puts + 1")} END || ':' || text FROM ps JOIN fs ON fs.conv_id IS NOT DISTINCT FROM ps.conv_id WHERE edit IN ('K', 'R')
    UNION ALL SELECT ed.conv_id, 1000000000, j, {at.format("total + j")} || ':' FROM ed JOIN fs ON fs.conv_id IS NOT DISTINCT FROM ed.conv_id, range(1, 3) r(j) WHERE j <= length(tail)
), tx AS (
    SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k, j)) AS digest FROM ln GROUP BY conv_id
), st AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial NOT IN ('su', 'ua', 'au') AS wrong FROM rw) GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ed ON ed.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN tx ON tx.conv_id IS NOT DISTINCT FROM o.conv_id
"""


OP13_SQL = _op13_sql()


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP2_SQL = rf"""
WITH RECURSIVE wd AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
st AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM wd),
cl AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM st GROUP BY s),
sh AS (SELECT c, n, unnest(s) AS g FROM cl),
pr AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS met FROM sh a JOIN sh b ON a.g = b.g AND a.c < b.c AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY a.c, b.c, a.n, b.n),
lk AS (SELECT a, b FROM pr WHERE 100 * met >= 90 * (na + nb - met)),
bi AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
rc AS (SELECT c AS a, c AS b FROM cl WHERE n > 0 UNION SELECT rc.a, bi.b FROM rc JOIN bi ON bi.a = rc.b),
mn AS (SELECT a, min(b) AS component FROM rc GROUP BY a)
SELECT st.doc_id, CAST(len(st.s) AS BIGINT) AS n_shingles, CASE WHEN len(st.s) = 0 THEN st.doc_id ELSE component END AS component_id
FROM st JOIN cl ON cl.s = st.s LEFT JOIN mn ON mn.a = cl.c
"""
OP8_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iv AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM iw, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= len(w) - least(10, len(w)) + 1),
ns AS (SELECT DISTINCT n FROM iv),
dv AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM dw, ns WHERE len(w) >= n),
hi AS (SELECT doc_id, dv.n AS n, x.i AS i, item FROM dv JOIN iv ON iv.n = dv.n AND iv.g = dv.x.g),
cv AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hi) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hi) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN cv USING (doc_id) LEFT JOIN it USING (doc_id)
"""
OP9_SQL = """
WITH hx AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
ps AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM hx WHERE len(h) >= 200)),
ag AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY hash(g), g ORDER BY doc_id, i) AS k FROM ps) WHERE k > 1),
ru AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM ag)) GROUP BY doc_id, run),
sp AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS s, list(z ORDER BY a) AS e FROM ru GROUP BY doc_id)
SELECT hx.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN s IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda k: substr(h, CAST(2 * CASE WHEN k = 0 THEN 0 ELSE e[k] END + 1 AS BIGINT), CAST(2 * (CASE WHEN k = len(s) THEN len(h) // 2 ELSE s[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE e[k] END) AS BIGINT))), '') END)) AS kept_sha256
FROM hx LEFT JOIN sp USING (doc_id)
"""


QUERIES: dict[str, Query] = {
    "op1_html_text": op1_html_text,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_token_counts": op3_token_counts,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_toxicity": op6_toxicity,
    "op7_language_model": op7_language_model,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_windows": op12_chat_windows,
    "op13_turn_repair": op13_turn_repair,
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op8_decontamination": OP8_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_chat_windows": OP12_SQL,
    "op13_turn_repair": OP13_SQL,
}
