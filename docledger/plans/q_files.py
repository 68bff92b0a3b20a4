"""Queries over files and uploads: reading, routing, checks, names, audit log files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions import validation as C
from ..operators import scoring, upload
from ..session import cut, scratch_path
from ..sources import audit_log, files, synth
from .process import process_documents, read_text_documents
from .registry import query


@query("src1_read_files", "SELECT 'txt' AS kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM {documents}")
def _(t):
    root = scratch_path(t.spark, "files")
    one_line = F.translate("text", "\r\n", "  ")
    t["documents"].select("source", one_line.alias("text")).write.partitionBy("source").text(root)
    found = files.read_files(t.spark, root)
    return found.groupBy(F.substring_index("filename", ".", -1).alias("kind")).agg(F.sum("byte_size").alias("bytes"))


@query(
    "src2_csv_text",
    "SELECT count(*) AS n, CAST(sum(length(CAST(c_custkey AS VARCHAR) || ' ' || c_name || ', \"' || c_mktsegment || '\"')) AS BIGINT) AS chars FROM {customer}",
)
def _(t):
    root = scratch_path(t.spark, "csv")
    quoted = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    rows = t["customer"].select("c_nationkey", "c_custkey", quoted.alias("label"))
    rows.write.partitionBy("c_nationkey").option("escape", '"').csv(root)
    lines = files.read_csv_text(t.spark, root).select(F.explode_outer(F.split("text", "\n")).alias("line"))
    return lines.agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query(
    "src2_csv_long_values",
    """SELECT md5(string_agg(CAST(c_custkey AS VARCHAR) || ' ' || c_name || ', "' || c_mktsegment || '"' || chr(10) ||
         CASE WHEN c_custkey % 50 = 0 THEN repeat(c_name, 10000) ELSE 'line two' END, chr(10) ORDER BY c_custkey)) AS digest FROM {customer} GROUP BY c_nationkey""",
)
def _(t):
    # values with quotes, commas and line breaks, some of 180,000 characters: one file for each nation
    root = scratch_path(t.spark, "csv")
    tail = F.when(F.col("c_custkey") % 50 == 0, F.repeat("c_name", F.lit(10000))).otherwise("line two")
    label = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"\n'), tail)
    rows = t["customer"].select("c_nationkey", "c_custkey", label.alias("label"))
    placed = rows.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    placed.write.partitionBy("c_nationkey").option("escape", '"').csv(root)
    return files.read_csv_text(t.spark, root).select(F.md5("text").alias("digest"))


@query(
    "src3_flatten_doc",
    """SELECT doc_id, md5(string_agg(text, chr(10) ORDER BY part, idx)) AS digest FROM (
         SELECT CAST(conv_id AS VARCHAR) AS doc_id, 0 AS part, turn AS idx, text FROM {conversations} WHERE turn % 4 <> 1 AND trim(text) <> ''
         UNION ALL SELECT CAST(conv_id AS VARCHAR), 1, turn, role || ' ' || CAST(turn AS VARCHAR) FROM {conversations}) s GROUP BY doc_id""",
)
def _(t):
    c = t["conversations"].withColumn("doc_id", F.col("conv_id").cast("string"))
    paragraphs = c.select("doc_id", F.col("turn").alias("para_idx"), F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.col("text")).alias("text"))
    rows = c.select("doc_id", F.col("turn").alias("row_idx"), F.array("role", F.col("turn").cast("string")).alias("cells"))
    return files.flatten_doc(paragraphs, rows).select("doc_id", F.md5("text").alias("digest"))


@query("src4_join_pages", "SELECT CAST(conv_id AS VARCHAR) AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM {conversations} GROUP BY 1")
def _(t):
    pages = t["conversations"].select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("page"), "text")
    return files.join_pages(pages).select("doc_id", F.md5("text").alias("digest"))


@query(
    "src5_html_rows",
    """SELECT doc_id, CAST(2 * (r - 1) AS INT) AS row_idx, role || '|$5 & ' || CAST(turn AS VARCHAR) AS cells FROM (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) s
       UNION ALL SELECT doc_id, CAST(2 * (r - 1) + 1 AS INT), 'é<x>' FROM (SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM {conversations}) s""",
)
def _(t):
    html = F.concat(
        F.lit('<table border="1"><TR><td class="a"> '), F.col("role"), F.lit("\n</td><th><b>&#36;5</b> &amp; "), F.col("turn").cast("string"),
        F.lit("</th></TR><!-- <tr><td>no</td></tr> --><tr><td>&#xE9;&lt;x&gt;</td></tr></table>"),
    )
    tables = t["conversations"].select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(0).alias("page"), F.col("turn").alias("table_idx"), html.alias("html"))
    return files.html_rows(tables).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("src5_page_tables", "SELECT page_id, CAST(0 AS INT) AS n FROM {pages}")
def _(t):
    return t["pages"].select("page_id", F.size(files.table_cells(F.col("html"))).alias("n"))


@query(
    "src6_read_audit_day",
    "SELECT method, status, count(*) AS n FROM {v_audit} WHERE CAST(ts AS DATE) = DATE '2024-01-03' GROUP BY 1, 2",
)
def _(t):
    root = scratch_path(t.spark, "audit")
    audit_log.append_audit(t["v_audit"], root)
    return audit_log.read_audit(t.spark, root, "2024-01-03").groupBy("method", "status").agg(F.count("*").alias("n"))


@query(
    "src6_skip_corrupt_lines",
    "SELECT user_id, count(*) AS n, CAST(sum(duration_ms) AS BIGINT) AS ms FROM {v_audit} WHERE event_id % 17 <> 0 AND event_id % 23 <> 0 GROUP BY 1",
)
def _(t):
    e = F.col("event_id")
    lines = audit_log.to_lines(t["v_audit"]).select("value", F.xxhash64("value").alias("h"))
    # damage lines by what they hold: cut some short, blank others
    a = t["v_audit"].withColumn("damage", F.when(e % 17 == 0, "cut").when(e % 23 == 0, "blank").otherwise("none"))
    names = [c.split()[0] for c in audit_log.ENTRY.split(", ")]
    value = F.to_json(F.struct(*[F.col("ts").alias("timestamp") if n == "timestamp" else F.col(n) for n in names]))
    lines = a.select(F.when(F.col("damage") == "cut", F.substring(value, F.lit(1), F.length(value) - 3)).when(F.col("damage") == "blank", "  ").otherwise(value).alias("value"))
    return audit_log.parse_audit_lines(lines).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms"))


@query("snk1_append_audit", "SELECT CAST(ts AS DATE) AS dt, count(*) AS n FROM {v_audit} GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "audit")
    audit_log.append_audit(t["v_audit"].filter("seq % 2 = 0"), root)
    audit_log.append_audit(t["v_audit"].filter("seq % 2 = 1"), root)
    return audit_log.read_audit(t.spark, root).groupBy("dt").agg(F.count("*").alias("n"))


_CORPUS = """SELECT CAST(c_custkey AS BIGINT) % 4 AS kind FROM {customer}"""


@query(
    "src7_corpus_accuracy",
    f"""SELECT field, sum(n)::BIGINT AS correct, sum(n)::BIGINT AS total FROM (
          SELECT unnest(CASE kind WHEN 0 THEN ['name', 'address'] WHEN 1 THEN ['name', 'abn', 'bsb', 'account_number', 'annual_salary', 'salary', 'income']
            ELSE ['total_current_assets', 'total_assets', 'total_current_liabilities', 'total_liabilities', 'total_equity'] END) AS field, 1 AS n FROM ({_CORPUS}) c) s GROUP BY ROLLUP (field)""",
)
def _(t):
    ids = t.spread("customer").select(F.col("c_custkey").alias("id"))
    docs = cut(synth.synth_docs(ids))
    read = read_text_documents(docs.select("doc_id", "text"), synth.synth_rows(docs))
    return scoring.accuracy(scoring.score_fields(synth.synth_truth(ids), read)).select("field", "correct", "total")


@query(
    "rul5_process_documents",
    """SELECT CASE k % 4 WHEN 0 THEN 'text_native' WHEN 1 THEN 'text_native' WHEN 2 THEN NULL ELSE 'ocr' END AS path,
         k % 4 >= 2 AS failed, CASE WHEN k % 4 = 2 THEN 'unsupported file extension: ''.exe''' WHEN k % 4 = 3 THEN 'no text was read from this document' END AS error, count(*) AS n
       FROM {v_payslip_values} GROUP BY 1, 2, 3""",
)
def _(t):
    k = F.col("k")
    ext = F.element_at(F.array(F.lit(".docx"), F.lit(".PDF"), F.lit(".exe"), F.lit(".png")), (k % 4 + 1).cast("int"))
    docs = t.spread("v_payslip")
    inputs = docs.select("doc_id", F.concat(F.lit("slip"), ext).alias("filename"), F.length("text").alias("text_len"), "repayment")
    out = process_documents(inputs, docs.select("doc_id", "text")).join(docs.select("doc_id", "k"), "doc_id")
    r = F.col("ai_result")
    return out.groupBy(r["processing_path"].alias("path"), r["fields"].isNull().alias("failed"), r["error"].alias("error")).agg(F.count("*").alias("n"))


# --- checks --------------------------------------------------------------------------
@query(
    "val1_route",
    """SELECT id, CASE WHEN format IN ('PNG', 'JPG', 'JPEG') THEN 'ocr' WHEN format IN ('DOCX', 'CSV') THEN 'text_native' WHEN orderkey % 100 < 50 THEN 'ocr' ELSE 'text_native' END AS path
       FROM {v_document}""",
)
def _(t):
    name = F.concat(F.lit("a.b."), F.initcap("format"))
    return t["v_document"].select("id", C.route(name, (F.col("orderkey") % 100).cast("int"))["path"].alias("path"))


@query("val2_signature", "SELECT id, format = 'CSV' OR orderkey % 5 <> 0 AND NOT (orderkey % 7 = 0 AND format IN ('PDF', 'DOCX', 'PNG')) AS ok FROM {v_document}")
def _(t):
    k = F.col("orderkey")
    magic = F.element_at(F.create_map(*[F.lit(x) for kv in {**V.SIGNATURES, "CSV": "61"}.items() for x in kv]), F.col("format"))
    shown = F.when(k % 5 == 0, F.lit("00112233")).when(k % 7 == 0, F.substring(magic, F.lit(1), F.lit(6))).otherwise(F.concat(magic, F.lit("AABB")))
    return t["v_document"].select("id", C.signature_ok(F.col("format"), F.unhex(shown)).alias("ok"))


@query(
    "val3_declared_format",
    """SELECT id, CASE WHEN orderkey % 10 = 0 THEN 'PDF' WHEN orderkey % 10 = 1 THEN NULL ELSE format END AS format,
         CASE WHEN orderkey % 10 = 0 THEN 'application/pdf' WHEN orderkey % 10 = 1 THEN NULL WHEN format = 'PDF' THEN 'application/pdf' WHEN format = 'CSV' THEN 'text/csv' WHEN format = 'PNG' THEN 'image/png'
              WHEN format = 'DOCX' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'image/jpeg' END AS mime,
         CASE WHEN orderkey % 10 = 1 THEN 'Unsupported document format' END AS error FROM {v_document}""",
)
def _(t):
    k = F.col("orderkey")
    name = F.when(k % 10 == 0, "scan").when(k % 10 == 1, "scan.exe").otherwise(F.concat(F.lit("x."), F.lower("format")))
    return t["v_document"].select("id", C.declared_format(name).alias("d")).select("id", "d.*")


@query("val4_image_mime", "SELECT id, CASE orderkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS mime FROM {v_document}")
def _(t):
    raw = F.element_at(F.array(F.lit("89504E470D"), F.lit("FFD8FFE0"), F.lit("FFD8")), (F.col("orderkey") % 3 + 1).cast("int"))
    return t["v_document"].select("id", C.image_mime(F.unhex(raw)).alias("mime"))


@query(
    "val5_structure_verdict",
    """SELECT id AS doc_id, CASE WHEN format = 'DOCX' AND e.bad IS NOT NULL OR format = 'PDF' AND orderkey % 4 = 0 THEN 'INFECTED' ELSE scan_status END AS final_status,
         CASE WHEN format = 'DOCX' AND e.bad IS NOT NULL THEN 'Structural Validation Failed: DOCX file contains forbidden entry: ' || e.bad
              WHEN format = 'PDF' AND orderkey % 8 = 0 THEN 'Structural Validation Failed: PDF contains forbidden open action execution elements'
              WHEN format = 'PDF' AND orderkey % 4 = 0 THEN 'Structural Validation Failed: PDF contains forbidden embedded files' ELSE scan_message END AS final_message
       FROM {v_document} d LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS ln, 'word/Embeddings/' || CAST(min(l_linenumber) AS VARCHAR) AS bad FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY 1) e ON e.l_orderkey = d.orderkey""",
)
def _(t):
    line, entry = F.col("l_linenumber"), F.when(F.col("l_returnflag") == "R", "word/Embeddings/").otherwise("word/media/")
    entries = t["lineitem"].select(F.col("l_orderkey").cast("string").alias("doc_id"), line.alias("entry_idx"), F.concat(entry, line.cast("string")).alias("entry_name"))
    k = F.col("orderkey")
    docs = t["v_document"].select(F.col("id").alias("doc_id"), "format", "scan_status", "scan_message")
    flags = t["v_document"].select(F.col("id").alias("doc_id"), (k % 8 == 0).alias("has_open_action"), (k % 4 == 0).alias("has_embedded_files"))
    return upload.structure_verdict(docs, entries, flags).select("doc_id", "final_status", "final_message")


_SCAN = """SELECT id, CASE orderkey % 4 WHEN 0 THEN 'CLEAN' WHEN 1 THEN 'INFECTED' WHEN 2 THEN 'ERROR' ELSE '%s' END AS status,
    CASE orderkey %% 4 WHEN 0 THEN 'No malware detected.' WHEN 1 THEN 'Malware detected: Eicar-' || id || '.' || chr(10) || 'Document quarantined.'
      WHEN 2 THEN 'Malware scan returned an unrecognized response.' ELSE %s END AS message FROM {v_document}""".replace("orderkey % 4 WHEN", "orderkey %% 4 WHEN", 1)


def _replies(t):
    k = F.col("orderkey")
    return (
        F.when(k % 4 == 0, F.lit("stream: OK")).when(k % 4 == 1, F.concat(F.lit("stream: Eicar-"), F.col("id"), F.lit(" FOUND")))
        .when(k % 4 == 2, F.lit("UNKNOWN COMMAND")).otherwise(F.lit("stream: Win.BOOK FOUND").substr(1, 40))
    )


@query("val6_scan_verdict", _SCAN % ("CLEAN", "'No malware detected.'"))
def _(t):
    reply = F.replace(_replies(t), F.lit("BOOK"), F.lit("BOK"))
    return t["v_document"].select("id", C.scan_verdict(reply).alias("v")).select("id", "v.*")


@query("val6_scan_verdict_strict", _SCAN % ("INFECTED", "'Malware detected: Win.BOK.' || chr(10) || 'Document quarantined.'"))
def _(t):
    reply = F.replace(_replies(t), F.lit("BOOK"), F.lit("BOK"))
    return t["v_document"].select("id", C.scan_verdict(reply, strict=True).alias("v")).select("id", "v.*")


@query("val7_storage_gate", "SELECT id, CASE WHEN scan_status = 'CLEAN' THEN document_link ELSE 'REJECTED_NOT_STORED' END AS link, scan_status IS NULL OR scan_status = 'CLEAN' AS accessible FROM {v_document}")
def _(t):
    s = F.col("scan_status")
    return t["v_document"].select("id", C.stored_link(s, F.col("document_link")).alias("link"), C.accessible(s).alias("accessible"))


@query("val8_safe_name", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM {pages}")
def _(t):
    return t["pages"].select("page_id", C.safe_name(F.col("url")).alias("name"))


_UPLOADS = """(SELECT o_orderkey AS idx, CAST(o_custkey AS VARCHAR) AS uploader_id, 'f' || CAST(o_orderkey % 2 AS VARCHAR) AS base FROM {orders} WHERE o_orderkey % 3 <> 0)"""
_EXISTING = """(SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS uploader_id, 'f' || CAST(o_orderkey % 2 AS VARCHAR) AS base, CAST((o_orderkey // 3) % 5 AS BIGINT) AS c FROM {orders} WHERE o_orderkey % 3 = 0)"""


@query(
    "val9_unique_names",
    f"""SELECT u.idx, u.base || CASE WHEN f.c > 0 THEN ' (' || CAST(f.c AS VARCHAR) || ')' ELSE '' END || '.pdf' AS final_name
        FROM (SELECT *, row_number() OVER (PARTITION BY uploader_id, base ORDER BY idx) AS n FROM {_UPLOADS} u0) u
        JOIN (SELECT g.uploader_id, g.base, g.c, row_number() OVER (PARTITION BY g.uploader_id, g.base ORDER BY g.c) AS n
              FROM (SELECT uploader_id, base, unnest(range(0, count(*) + 6)) AS c FROM {_UPLOADS} u1 GROUP BY uploader_id, base) g
              LEFT JOIN {_EXISTING} e ON e.uploader_id = g.uploader_id AND e.base = g.base AND e.c = g.c WHERE e.c IS NULL) f
          ON f.uploader_id = u.uploader_id AND f.base = u.base AND f.n = u.n""",
)
def _(t):
    k = F.col("o_orderkey")
    base = F.concat(F.lit("f"), (k % 2).cast("string"))
    who = F.col("o_custkey").cast("string").alias("uploader_id")
    ups = t["orders"].filter(k % 3 != 0).select(who, k.alias("upload_idx"), F.concat(base, F.lit(".PDF")).alias("name"))
    held = t["orders"].filter(k % 3 == 0).select(who, upload.numbered_name(base, F.floor(k / 3) % 5, F.lit("pdf")).alias("name"))
    return upload.unique_names(ups, held).select(F.col("upload_idx").alias("idx"), "final_name")


_RIVALS = """(SELECT CAST(o_custkey % 200 AS VARCHAR) AS uploader_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS i, o_orderkey AS idx,
   'x' || CASE o_orderkey % 6 WHEN 0 THEN ' (' || CAST(o_orderkey % 23 + 1 AS VARCHAR) || ')' WHEN 1 THEN ' (' || CAST(o_orderkey % 5 + 1 AS VARCHAR) || ') (1)' WHEN 2 THEN ' (0)' ELSE '' END AS base
   FROM {orders} WHERE o_orderkey % 11 <> 0)"""


@query(
    "val9_competing_names",
    f"""WITH RECURSIVE rivals AS {_RIVALS},
    steps AS (
      SELECT CAST(o_custkey % 200 AS VARCHAR) AS uploader_id, 0::BIGINT AS i, NULL::BIGINT AS idx, '' AS final_name,
        list(DISTINCT 'x (' || CAST(o_orderkey % 13 + 1 AS VARCHAR) || ')') FILTER (o_orderkey % 11 = 0) AS held FROM {{orders}} GROUP BY ALL
      UNION ALL
      SELECT uploader_id, i, idx, name || '.pdf', list_append(held, name) FROM (
        SELECT s.uploader_id, r.i, r.idx, coalesce(held, []::VARCHAR[]) AS held,
          list_filter(list_transform(range(0, len(coalesce(held, []::VARCHAR[])) + 1), lambda c: base || CASE WHEN c > 0 THEN ' (' || CAST(c AS VARCHAR) || ')' ELSE '' END),
            lambda n: NOT list_contains(coalesce(held, []::VARCHAR[]), n))[1] AS name
        FROM steps s JOIN rivals r ON r.uploader_id = s.uploader_id AND r.i = s.i + 1)
    )
    SELECT idx, final_name FROM steps WHERE i > 0""",
)
def _(t):
    """Half of an uploader's files are called alike, the others like the names those would get."""
    k = F.col("o_orderkey")
    number = lambda n: F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    tail = F.when(k % 6 == 0, number(k % 23 + 1)).when(k % 6 == 1, F.concat(number(k % 5 + 1), F.lit(" (1)"))).when(k % 6 == 2, " (0)").otherwise("")
    who = (F.col("o_custkey") % 200).cast("string").alias("uploader_id")
    ups = t["orders"].filter(k % 11 != 0).select(who, k.alias("upload_idx"), F.concat(F.lit("x"), tail, F.lit(".PDF")).alias("name"))
    held = t["orders"].filter(k % 11 == 0).select(who, F.concat(F.lit("x"), number(k % 13 + 1), F.lit(".pdf")).alias("name"))
    return upload.unique_names(ups, held).select(F.col("upload_idx").alias("idx"), "final_name")


@query("val10_batch_gate", "SELECT user_id, count(*) AS n, count(*) > 10 AS too_many FROM {events} GROUP BY user_id")
def _(t):
    batch = t["events"].select(F.col("user_id").alias("request_id"), (F.col("value") * 1000).cast("long").alias("byte_size"))
    return upload.batch_gate(batch).groupBy(F.col("request_id").alias("user_id")).agg(F.count("*").alias("n"), F.bool_and(F.col("batch_error").isNotNull()).alias("too_many"))
