"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, fingerprints, gif, lexical_search, line_dedup, minhash, packing, pieces, pii, quality, secrets, suffix_dedup, token_counts
from .common import checkpointed, shared_checkpoint_dir

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicate_classes(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_documents(spark, sf_dir), VOCABULARY)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(_documents(spark, sf_dir), f"{TOKENIZERS}/piece_bpe_32k.model")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("p_document", "p_host", "p_path", "p_posterior")], "keep")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_documents(spark, sf_dir))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.media_digests(_documents(spark, sf_dir))


def op8_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_prints(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(_documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = token_counts.token_counts(_documents(spark, sf_dir), VOCABULARY)
    return table.withColumn("quantile", F.round("quantile", 9))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_digests(given, conversations.damaged(given))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digests(_documents(spark, sf_dir), f"{shared_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# --- parts of the operators' results that SQL can repeat ------------------------------------


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 says of equal texts."""
    return op1_minhash(spark, sf_dir).select("doc_id", "copy_of")


def packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of op2's operator over lengths in bytes, and whether each lies within its bin."""
    lengths = _documents(spark, sf_dir).select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    fits = F.coalesce((F.col("bin_offset") + F.col("length") <= F.col("bin_used")) & (F.col("bin_used") <= F.col("capacity")), F.col("length") == 0)
    return packing.pack_lengths(lengths).select("doc_id", "piece", "start", "length", fits.alias("fits"))


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def sentencepiece_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of op4's rows agree with the model's own library, and decode to their whole text."""
    texts = _documents(spark, sf_dir).groupBy(F.col("doc_id").alias("d"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("there"))
    decoded = op4_sentencepiece(spark, sf_dir).groupBy("doc_id", "decoded_sha256", "parity").agg(F.count(F.lit(1)).alias("n"))
    # by rows of one id and text, so that missing and repeated ids count as they come
    held = decoded.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("decoded_sha256") == F.col("text_sha256")), "left")
    return held.groupBy("parity", (F.col("n") <= F.coalesce("there", F.lit(0))).alias("whole")).agg(F.sum("n").alias("n"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_gif(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "n_frames", "duration_ms")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_merkle_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def byte_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of op10's operator over lengths in bytes."""
    lengths = _documents(spark, sf_dir).select(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_tokens"))
    return token_counts.limit_table(checkpointed(token_counts.histogram(lengths))).withColumn("quantile", F.round("quantile", 9))


def byte_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = [i / 8 for i in range(1, 9)]
    return token_counts.quantiles(checkpointed(byte_limits(spark, sf_dir)), shares)


def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.at_limits(checkpointed(byte_limits(spark, sf_dir)), _LIMITS)


_LIMITS = (0, 1, 100, 512, 2048, 8192, 1 << 20)
_EIGHTHS = ", ".join(f"CAST({i / 8} AS DOUBLE)" for i in range(1, 9))
_TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_BYTES = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents"
_DIGITS = "[CAST(c AS INTEGER) FOR c IN string_split(regexp_replace(x, '[^0-9]', '', 'g'), '')]"
_LUHN = f"""list_sum([CASE WHEN (len(ds) - i) % 2 = 0 THEN ds[i] WHEN ds[i] > 4 THEN 2 * ds[i] - 9 ELSE 2 * ds[i] END FOR i IN range(1, len(ds) + 1)])"""

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_gif": op7_gif,
    "op8_merkle_fingerprints": op8_merkle_fingerprints,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_lexical_search": op13_lexical_search,
    "copies": copies,
    "packed_pieces": packed_pieces,
    "pii_base_counts": pii_base_counts,
    "sentencepiece_parity": sentencepiece_parity,
    "secret_base_counts": secret_base_counts,
    "media_payloads": media_payloads,
    "edited_texts": edited_texts,
    "byte_limits": byte_limits,
    "byte_quantiles": byte_quantiles,
    "byte_totals": byte_totals,
}
_LIMIT_TABLE = f"""WITH n AS ({_BYTES}), h AS (SELECT n AS n_tokens, count(*) AS n_docs FROM n GROUP BY n),
c AS (SELECT *, sum(n_docs) OVER down AS docs_at_least, sum(n_docs * n_tokens) OVER down AS tokens_at_least, sum(n_docs) OVER () AS total_docs, sum(n_docs * n_tokens) OVER () AS total_tokens FROM h WINDOW down AS (ORDER BY n_tokens DESC))
SELECT n_tokens, n_docs, CAST(docs_at_least AS BIGINT) AS docs_at_least, CAST(tokens_at_least AS BIGINT) AS tokens_at_least, CAST(total_docs AS BIGINT) AS total_docs, CAST(total_tokens AS BIGINT) AS total_tokens,
CAST(total_tokens - tokens_at_least + n_tokens * docs_at_least AS BIGINT) AS truncated_tokens, CAST(docs_at_least - n_docs AS BIGINT) AS docs_truncated, round((total_docs - docs_at_least + n_docs) / total_docs, 9) AS quantile FROM c"""
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _repair_sql() -> str:
    """The damage's checksum bit by bit, the faults by windows, and the least edits by recursion from each conversation's end."""
    shift = "(CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, CAST(3988292384 AS BIGINT)) ELSE {0} >> 1 END)"
    table = "n"
    steps = []
    for i in range(8):
        steps.append(f"c{i + 1} AS (SELECT k, {shift.format(table)} AS n FROM {'c' + str(i) if i else '(SELECT k, k AS n FROM (SELECT unnest(range(256)) AS k))'})")
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}
    least = lambda options: f"list_min([x FOR x IN [{', '.join(options)}] IF x IS NOT NULL])"
    with_letter = lambda cost, letter, to, line: f"CASE WHEN v[{to + 1}] IS NOT NULL THEN {{'c': v[{to + 1}].c + {cost}, 's': '{letter}' || v[{to + 1}].s, 't': {line} || v[{to + 1}].t}} END"
    consuming = []
    for state, to in moves.items():
        options = [with_letter("2", "D", state, "''")]
        for label, after in to.items():
            options.append(f"CASE WHEN NOT must_go AND substr(role, 1, 1) = '{label}' THEN {with_letter('extra', 'K', after, 'chr(10) || role || chr(58) || text')} END")
            if label in names:
                options.append(f"CASE WHEN NOT must_go THEN {with_letter('extra + 1', 'R', after, f"chr(10) || '{names[label]}' || chr(58) || text")} END")
        consuming.append(least(options))
    inserting = []
    for state, to in moves.items():
        options = [f"v[{state + 1}]", *[with_letter("5", "I", after, f"chr(10) || '{names[label]}' || chr(58)") for label, after in to.items() if label in names]]
        inserting.append(least(options))
    again = lambda inner: f"list_transform([{inner}], lambda v: [{', '.join(inserting)}])[1]"
    relaxed = again(again(again("w")))
    end = "[{'c': 0, 's': '', 't': ''}, NULL, NULL, {'c': 0, 's': '', 't': ''}]"
    return f"""WITH RECURSIVE {", ".join(steps)},
crc AS (SELECT list(n ORDER BY k) AS tb FROM c8),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(k, '')]), lambda c, b: xor(c >> 8, tb[CAST(xor(c & 255, b) AS BIGINT) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS f FROM keyed, crc),
after AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM summed WHERE f != 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, trim(text, {_WHITE}) AS body FROM after),
told AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM told GROUP BY conv_id),
marked AS (SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM told),
walk AS (SELECT conv_id, n AS i, {again(again(again(end)))} AS v FROM counted
  UNION ALL SELECT conv_id, i - 1, {relaxed} FROM (SELECT w.conv_id, w.i, [{", ".join(consuming)}] AS w FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i)),
best AS (SELECT conv_id, v[1] AS b FROM walk WHERE i = 0)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.s, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_line_dedup": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT r, doc_id, lines, [translate(trim(x, {_WHITE}), '{_UPPER}', '{_LOWER}') FOR x IN lines] AS keys FROM t),
f AS (SELECT key FROM (SELECT r, unnest(list_distinct(keys)) AS key FROM k) WHERE key != '' GROUP BY key HAVING count(*) >= 10),
e AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, unnest(keys) AS key FROM k)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM (SELECT e.r, e.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, string_agg(e.line, chr(10) ORDER BY e.i) FILTER (WHERE f.key IS NULL) AS kept FROM e LEFT JOIN f ON e.key = f.key GROUP BY e.r, e.doc_id)""",
    "op13_lexical_search": f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts FROM documents),
d AS (SELECT r, doc_id, len(ts) AS n, ts FROM t WHERE len(ts) > 0), s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s),
m AS (SELECT r, doc_id, 10 + (90 * n * n_docs) // n_terms AS m FROM d, s),
x AS (SELECT q.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m ON m.r = p.r GROUP BY q.item_id, m.r, m.doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM x WHERE score > 0) WHERE rank <= 10""",
    "copies": "SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy_of FROM documents",
    "packed_pieces": f"""WITH n AS ({_BYTES}), p AS (SELECT doc_id, n, unnest(generate_series(0, greatest(CAST(floor((n - 1) / 16384) AS BIGINT), 0))) AS piece FROM n)
SELECT doc_id, piece, piece * 16384 AS start, least(n - piece * 16384, 16384) AS length, true AS fits FROM p""",
    "pii_base_counts": f"""WITH t AS ({_TEXTS}),
f AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+') AS email, regexp_extract_all(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS ip,
  regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+') AS card, regexp_extract_all(text, '[+][0-9][ ().0-9-]+[0-9]') AS phone FROM t),
cards AS (SELECT doc_id, x, {_DIGITS} AS ds FROM (SELECT doc_id, unnest(card) AS x FROM f)),
good AS (SELECT doc_id, count(*) AS n FROM cards WHERE len(ds) BETWEEN 12 AND 19 AND {_LUHN} % 10 = 0 GROUP BY doc_id)
SELECT f.doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len([x FOR x IN ip IF list_max([CAST(p AS DOUBLE) FOR p IN string_split(x, '.')]) <= 255]) AS BIGINT) AS n_ip, CAST(coalesce(good.n, 0) AS BIGINT) AS n_card,
  CAST(len([x FOR x IN phone IF length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15]) AS BIGINT) AS n_phone FROM f LEFT JOIN good USING (doc_id)""",
    "sentencepiece_parity": "SELECT true AS parity, true AS whole, count(*) AS n FROM documents",
    "secret_base_counts": f"""WITH t AS ({_TEXTS})
SELECT doc_id, CAST(len([x FOR x IN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 1) IF length(x) >= 6]) AS BIGINT) AS n_assign,
  CAST(len([x FOR x IN regexp_extract_all(text, 'AKIA[A-Z0-9]+') IF length(x) >= 20]) AS BIGINT) AS n_access, CAST(len([x FOR x IN regexp_extract_all(text, '[0-9a-f]+') IF length(x) >= 24]) AS BIGINT) AS n_hex FROM t""",
    "media_payloads": f"""WITH t AS (SELECT doc_id, text, strlen(text) AS n, greatest(1, CAST(ceil(strlen(text) / 64) AS BIGINT)) AS rows FROM ({_TEXTS}))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, rows * 64 AS payload_bytes, sha256(text || repeat(chr(0), CAST(rows * 64 - n AS BIGINT))) AS payload_sha256,
  CAST(ceil(rows / 512) AS BIGINT) AS n_frames, CAST(100 * ceil(rows / 512) AS BIGINT) AS duration_ms FROM t""",
    "edited_texts": f"""WITH t AS ({_TEXTS}), x AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after, length(text) // 2 AS half FROM t)
SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - half) || substring(after, 1, half)) AS edited_sha256 FROM x""",
    "byte_limits": _LIMIT_TABLE,
    "byte_quantiles": f"WITH n AS ({_BYTES}) SELECT unnest([{_EIGHTHS}]) AS probability, unnest(quantile_disc(n, [{_EIGHTHS}])) AS n_tokens FROM n",
    "byte_totals": f"WITH n AS ({_BYTES}) SELECT CAST(c AS BIGINT) AS context_limit, CAST(sum(least(n, c)) AS BIGINT) AS truncated_tokens, count(*) FILTER (WHERE n > c) AS docs_truncated FROM n, (VALUES {', '.join(f'({x})' for x in _LIMITS)}) v(c) GROUP BY c",
}
