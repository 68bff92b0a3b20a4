"""One query for each operator over the given tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import audio, chat, language, mixing, order_minhash, pieces, prefix_trie, quality, records, simhash, structure, suffixes, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every document, and whether it decodes to the same text."""
    both = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.Vocabulary(), decoded="decoded")
    return both.select(
        "doc_id", "ids", F.size("ids").alias("n_ids"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the component of each."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query
def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 50 words and more that documents have in common."""
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as a raw transcript, its turns recovered and rendered."""
    conversations = table(spark, sf_dir, "conversations")
    lines = chat.transcribe(conversations).select("conv_id", "turn", "at", "line")
    found = chat.turns(lines, chat.train_on(conversations), ["turn", "at"])
    return found.select("conv_id", F.col("turn_no").cast("long").alias("turn_no"), "role", "text", "rendered")


ORACLES["op4_chat"] = """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no, role, text,
  '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered
FROM conversations
"""


@query
def op5_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as stored samples, and the features read back from them."""
    media = audio.with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return audio.with_features(media.drop("text")).drop("media")


@query
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of every document and of its edited text, and their likeness."""
    return order_minhash.compare_edits(table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives, read back, and placed in their URL's history."""
    captures = warc.archived(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_no")


ORACLES["op7_warc"] = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
    regexp_replace(regexp_replace(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS bare
  FROM pages
),
digests AS (
  SELECT page_id, strlen(html) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
    lower(regexp_extract(bare, '^([^/?]*)', 1)) AS host, regexp_replace(bare, '^[^/?]*', '') AS path, bare
  FROM payloads
),
kept AS (SELECT payload_digest, max(page_id) AS keeper FROM digests GROUP BY payload_digest),
keyed AS (
  SELECT page_id, payload_bytes, d.payload_digest, keeper,
    CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END AS url_key
  FROM digests d JOIN kept k ON d.payload_digest = k.payload_digest
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to, url_key,
  row_number() OVER (PARTITION BY url_key ORDER BY page_id % 315360000, page_id) AS capture_no
FROM keyed
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document stands in a mixture of all sources to tempered weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    placed = mixing.schedule(docs, mixing.tempered_shares(docs))
    return placed.select("doc_id", "source", *[F.col(f"__{c}").cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "place")])


ORACLES["op8_mixing"] = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
shares AS (SELECT source, greatest(1, round(1000 * w / (SELECT sum(w) FROM sizes)))::BIGINT AS share FROM sizes),
lists AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list(share ORDER BY source NULLS FIRST) AS a, sum(share)::BIGINT AS q FROM shares),
steps AS (
  SELECT 0::BIGINT AS t, list_transform(a, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick, 0::BIGINT AS k FROM lists
  UNION ALL
  SELECT t + 1, list_transform(done, lambda c, i: c + (i = p)::BIGINT), p, done[p]
  FROM (
    SELECT t, done, list_min(list_transform(range(1, len(a) + 1), lambda i:
      CASE WHEN (done[i] * q) // a[i] <= t THEN (((done[i] + 1) * q + a[i] - 1) // a[i]) * 1000000 + i ELSE 9000000000000000000 END)) % 1000000 AS p
    FROM steps, lists WHERE t < q
  )
),
plan AS (SELECT s[pick] AS source, a[pick] AS share, q, k, t - 1 AS pos FROM steps, lists WHERE t > 0),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS r
  FROM documents
)
SELECT doc_id, d.source, r // 16 AS block, ((r // 16) * q) // share AS release, ((r // 16 + 1) * q + share - 1) // share AS deadline,
  ((r // 16) // share) * q + pos AS slot, r % 16 AS place
FROM ranked d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND (r // 16) % share = k
"""


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from four folds of five of the labels."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three folds of four."""
    return language.identify(table(spark, sf_dir, "documents"))


def _sql_crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, which must not be empty."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {byte}), 4294967295)"


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shared beginnings of rebuilt conversations, with what sharing them saves."""
    conversations = table(spark, sf_dir, "conversations")
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.turns(conversations), conversations))


ORACLES["op11_prefix_trie"] = rf"""
WITH own AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL
),
lists AS (SELECT conv_id, list({{'id': id, 'words': words}} ORDER BY i) AS t FROM own GROUP BY conv_id),
named AS (SELECT conv_id, t, conv_id - conv_id % 20 AS template, {_sql_crc32("conv_id::VARCHAR")} % 4 AS h FROM lists),
built AS (SELECT n.conv_id, list_concat(coalesce(o.t, [])[1:h], n.t[h + 1:]) AS t FROM named n LEFT JOIN lists o ON o.conv_id = n.template),
walks AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM built),
found AS (
  SELECT t[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(t) = depth), '')) AS ends_sha256,
    any_value(CASE WHEN depth = 0 THEN 0 ELSE t[depth].words END) AS words
  FROM walks GROUP BY t[1:depth], depth
),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM found WHERE depth > 0 GROUP BY path[1:depth - 1]),
joined AS (SELECT f.*, coalesce(c.n, 0) AS n_children FROM found f LEFT JOIN children c ON f.path = c.path),
above AS (SELECT path, words, n_convs, n_children, unnest(range(0, depth + 1)) AS up FROM joined),
sums AS (
  SELECT path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM above GROUP BY path[1:up]
)
SELECT j.conv_id, j.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, j.n_convs::BIGINT AS n_convs, j.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, j.ends_sha256
FROM joined j JOIN sums s ON j.path = s.path LEFT JOIN joined p ON j.depth > 0 AND p.path = j.path[1:j.depth - 1]
"""


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged in known ways, its faults, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    found = structure.repair(structure.damaged(rows)).withColumnRenamed("conv_id", "c")
    every = rows.select("conv_id").distinct()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(structure.NOTHING)).alias("repaired_sha256"),
    )


def _sql_least(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}])[1]"


def _sql_more(state: str, cost: str, letter: str, line: str | None = None) -> str:
    text = f"{state}.r" if line is None else f"list_append({state}.r, {line})"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {text}}}"


def _structure_sql() -> str:
    user, assistant, never = "'user:'", "'assistant:'", "{'c': 1000000000, 'a': '', 'r': []::VARCHAR[]}"
    more = _sql_more
    second = _sql_least("v2", *[more(f"v{k}", "5", "I", user) for k in (0, 1, 3)])
    third = _sql_least("v3", more("w2", "5", "I", assistant))

    def stays(initial: str, sources: tuple[int, ...], states: str, line: str) -> list[str]:
        kept = [f"CASE WHEN may_stay AND initial = '{initial}' THEN {more(f'{states}{k}', 'extra', 'K', 'line')} ELSE {never} END" for k in sources]
        changed = [f"CASE WHEN may_stay THEN {more(f'{states}{k}', '(extra + 1)', 'R', line)} ELSE {never} END" for k in sources]
        return kept + (changed if initial != "s" else [])

    new0 = more("v0", "2", "D")
    new1 = _sql_least(more("v1", "2", "D"), *stays("s", (0,), "v", "''"))
    new2 = _sql_least(more("w2", "2", "D"), *[x.replace("v3", "w3") for x in stays("u", (0, 1, 3), "v", f"{user} || text")])
    new3 = _sql_least(more("w3", "2", "D"), *stays("a", (2,), "w", f"{assistant} || text"))
    return rf"""
WITH RECURSIVE spaced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_sql_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM spaced WHERE kind <> 0
),
ranked AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS is_again,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') AS is_cut,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 32), md5(text), copy) AS i
  FROM hurt
),
lines AS (
  SELECT conv_id, turn, text, initial, i, is_blank, NOT is_blank AND is_again AS is_again, NOT is_blank AND NOT is_again AND is_cut AS is_cut,
    NOT is_blank AND NOT is_again AS may_stay, CASE WHEN is_cut THEN 5 ELSE 0 END AS extra, role || ':' || text AS line,
    i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS is_illegal
  FROM ranked
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (is_blank) AS blank,
    count(*) FILTER (is_again) AS duplicate, count(*) FILTER (is_cut) AS truncated, count(*) FILTER (is_illegal) AS illegal, max(i) AS n
  FROM lines GROUP BY conv_id
),
steps AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS v0, {never} AS v1, {never} AS v2, {never} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {new0}, {new1}, {new2}, {new3}
  FROM (
    SELECT *, {third} AS w3 FROM (
      SELECT l.*, v0, v1, v2, v3, {second} AS w2
      FROM steps s JOIN lines l ON l.conv_id IS NOT DISTINCT FROM s.conv_id AND l.i = s.i + 1
    )
  )
),
ends AS (
  SELECT conv_id, {_sql_least("v0", third)} AS e
  FROM (SELECT s.*, {second} AS w2 FROM steps s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.i)
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(array_to_string(e.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLES["op12_structure_repair"] = _structure_sql()


@query
def op13_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as binary records in order of their ids and read back."""
    folder = scratch_path(spark, "records")
    index = records.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    found = records.with_starts(records.read(index, folder), index)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
