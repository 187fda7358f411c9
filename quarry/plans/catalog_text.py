"""Queries over texts: table blocks, packed items, loose JSON, cutters that SQL calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import chunking as C
from quarry.functions import loose_json as J
from quarry.functions import page_blocks as B
from quarry.functions import sql_functions
from quarry.plans import docgen
from quarry.plans.catalog import query
from quarry.plans.fixtures import Tables
from quarry.sources import files

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


# Tables in page texts

_PAGE_TEXT = """CASE WHEN tables = '' THEN text ELSE left(text, 200) || chr(10) || tables || chr(10) || '  | 1 | two |' || chr(10) || substring(text, 201) || chr(10) || 'a | --- b' END
    || CASE WHEN page_no % 5 = 2 THEN chr(10) || '## Table (Markdown) ' || left(text, 9000) ELSE '' END"""


@query(
    rf""", p AS (SELECT doc_id, page_no, {_PAGE_TEXT} AS t FROM page_rows), l AS (SELECT *, regexp_matches(line, '^[ \t]*(\|(.*\|)?[ \t]*|.*\| ?---.*)$') AS is_table FROM (SELECT doc_id, page_no, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM p)),
    s AS (SELECT *, sum(CASE WHEN is_table THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY pos) AS run FROM l),
    r AS (SELECT doc_id, page_no, min(pos) AS pos, {_STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS b FROM s WHERE is_table GROUP BY doc_id, page_no, run),
    m AS (SELECT doc_id, page_no, 0 AS pos, left({_STRIP.format("substring(t, strpos(t, '## Table (Markdown)') + 19)")}, 8000) AS b FROM p WHERE contains(t, '## Table (Markdown)') AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = p.doc_id AND r.page_no = p.page_no))
    SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY pos) - 1 AS block_no, sha256(b) AS block_hash FROM (SELECT * FROM r UNION ALL SELECT * FROM m) WHERE length(b) > 20""",
    "page_rows",
)
def text_table_blocks(t: Tables) -> DataFrame:
    """The table blocks of pages whose texts hold tables, and of pages that only announce one."""
    pages = t.pages().select("doc_id", "page_no", F.expr(_PAGE_TEXT.replace("chr(10)", "'\\n'")).alias("text"))
    found = B.table_blocks(pages, ["doc_id", "page_no"])
    return found.select("doc_id", "page_no", F.col("block_no").cast("long").alias("block_no"), F.sha2("table_text", 256).alias("block_hash"))


# Items packed to a length


@query(
    rf"""WITH RECURSIVE i AS (SELECT conv_id, turn, role, {_STRIP.format("coalesce(text, '')")} AS x FROM conversations),
    p AS (SELECT conv_id, substring(x, k * 300 + 1, 300) AS piece, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, x, k) AS n FROM (SELECT *, unnest(range(CAST(ceil(length(x) / 300.0) AS BIGINT))) AS k FROM i)),
    g AS (SELECT conv_id, n, piece AS pack, 0 AS pack_no FROM p WHERE n = 1
      UNION ALL SELECT g.conv_id, p.n, CASE WHEN length(pack) + 7 + length(piece) <= 300 THEN pack || chr(10) || chr(10) || '---' || chr(10) || chr(10) || piece ELSE piece END,
        CASE WHEN length(pack) + 7 + length(piece) <= 300 THEN pack_no ELSE pack_no + 1 END FROM g JOIN p ON p.conv_id = g.conv_id AND p.n = g.n + 1)
    SELECT conv_id, CAST(pack_no AS BIGINT) AS pack_no, CAST(length(arg_max(pack, n)) AS BIGINT) AS n_chars, sha256(arg_max(pack, n)) AS pack_hash FROM g GROUP BY conv_id, pack_no"""
)
def packed_turns(t: Tables) -> DataFrame:
    """The turns of each conversation packed into texts of 300 characters at most."""
    found = B.pack_items(t.raw("conversations"), "conv_id", ["turn", "role"], 300)
    return found.select("conv_id", F.col("pack_no").cast("long").alias("pack_no"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("pack_hash"))


# Loose JSON


def _answer() -> Column:
    """What a page model might say of an event, in one of seven ways."""
    return F.expr(
        r"""CASE event_id % 7
          WHEN 0 THEN concat('{"text": " ', event_type, ' ", "tables": "t', user_id, '", "notes": 5}')
          WHEN 1 THEN concat('Here it is:\n```json\n{"text": ["', event_type, '", "two"], "tables": [{"caption": "c", "markdown": " m "}, "', user_id, '", 7, {"caption": " "}]}\n```\nDone {.')
          WHEN 2 THEN concat('See {not json} and {"text": "a } brace \\" in ', event_type, '", "figures": {"description": "d", "data_table_markdown": ', user_id, '}} {"text": "second"}')
          WHEN 3 THEN concat('  no object in ', event_type, ' ')
          WHEN 4 THEN concat('[1, {"text": null, "tables": null, "figures": [null, {"caption": {"x": 1}}]}]')
          WHEN 5 THEN concat('{"tables": {"markdown": "only", "caption": null}, "text": {"k": ', user_id, '}, "notes": "n')
          ELSE concat('{"a": {"b": {"c": ', user_id, '}}, "figures": "f"}') END"""
    )


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || 'two' WHEN 2 THEN 'a } brace " in ' || event_type WHEN 3 THEN 'no object in ' || event_type WHEN 4 THEN '' WHEN 5 THEN '' ELSE '' END AS text,
    CASE event_id % 7 WHEN 0 THEN '/t' || user_id WHEN 1 THEN 'c/m;/' || user_id WHEN 5 THEN '/only' ELSE '' END AS tables,
    CASE event_id % 7 WHEN 2 THEN '/d/' || user_id WHEN 4 THEN '{"x":1}//' WHEN 6 THEN '/f/' ELSE '' END AS figures, CASE event_id % 7 WHEN 0 THEN '5' ELSE '' END AS notes FROM events"""
    .replace("WHEN 5 THEN '' ELSE '' END AS text", "WHEN 5 THEN '{\"tables\": {\"markdown\": \"only\", \"caption\": null}, \"text\": {\"k\": ' || user_id || '}, \"notes\": \"n' ELSE '' END AS text")
    .replace("WHEN 5 THEN '/only' ", "")
)
def payloads_from_answers(t: Tables) -> DataFrame:
    """Payloads out of answers: a plain object, a fenced one, one in prose with braces and quotes, none, one in a list, a broken one, nested ones."""
    found = t.raw("events").select("event_id", J.page_payload(_answer(), F.lit(1)).alias("p"))

    def lines(name: str, *fields: str) -> Column:
        return F.array_join(F.transform(F.col("p")[name], lambda x: F.concat_ws("/", *(x[f] for f in fields))), ";").alias(name)

    return found.select("event_id", F.col("p.text").alias("text"), lines("tables", "caption", "markdown"), lines("figures", "caption", "description", "data_table_markdown"), F.col("p.notes").alias("notes"))


@query("SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) FILTER (json_type(props) = 'OBJECT') AS objects FROM events GROUP BY 1")
def props_as_variant(t: Tables) -> DataFrame:
    """A field of JSON properties by type of event."""
    rows = t.raw("events").select("event_type", F.try_parse_json("props").alias("v"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(F.try_variant_get("v", "$.k", "long")).alias("k_sum"), F.count(F.when(J.is_object(F.col("v")), 1)).alias("objects"))


# Cutters


def _recursive_sql(size: int, overlap: int) -> str:
    """Each separator is a level: texts that are too long are cut behind it, and parts that fit together are put together by a walk."""

    def strip(x: str) -> str:
        return _STRIP.format(x)

    out = ["p0 AS (SELECT doc_id, CAST(1 AS BIGINT) AS n, coalesce(text, '') AS t FROM documents)"]
    for k, separator in enumerate(C.SEPARATORS):
        out.append(f"k{k} AS (SELECT doc_id, n, {strip('t')} AS t FROM p{k} WHERE {strip('t')} <> '')")
        if separator:
            mark = " || ".join(f"chr({ord(c)})" for c in separator)
            out += [
                f"""s{k} AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS i, part || {mark} AS x FROM (SELECT doc_id, n, unnest(string_split(t, {mark})) AS part, generate_subscripts(string_split(t, {mark}), 1) AS pos FROM k{k} WHERE length(t) > {size}) WHERE part <> '')""",
                f"""w{k} AS (SELECT doc_id, n, i, CAST(0 AS BIGINT) AS g, length(x) AS filled, x FROM s{k} WHERE i = 1
                  UNION ALL SELECT s.doc_id, s.n, s.i, CASE WHEN w.filled + length(s.x) <= {size} THEN w.g ELSE w.g + 1 END, CASE WHEN w.filled + length(s.x) <= {size} THEN w.filled + length(s.x) ELSE length(s.x) END, s.x FROM w{k} w JOIN s{k} s ON s.doc_id = w.doc_id AND s.n = w.n AND s.i = w.i + 1)""",
                f"c{k} AS (SELECT doc_id, n, g, string_agg(x, '' ORDER BY i) AS t FROM w{k} GROUP BY 1, 2, 3)",
            ]
        else:
            out.append(f"c{k} AS (SELECT doc_id, n, g, substring(t, g * {size} + 1, {size}) AS t FROM (SELECT doc_id, n, t, unnest(range(CAST(ceil(length(t) / {size}.0) AS BIGINT))) AS g FROM k{k} WHERE length(t) > {size}))")
        out.append(f"p{k + 1} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, g) AS n, t FROM (SELECT doc_id, n, 0 AS g, t FROM k{k} WHERE length(t) <= {size} UNION ALL SELECT doc_id, n, g, t FROM c{k} WHERE {strip('t')} <> ''))")
    last = len(C.SEPARATORS)
    out.append(f"lead_in AS (SELECT doc_id, n, t FROM p{last} WHERE n = 1 UNION ALL SELECT p.doc_id, p.n, {strip(f'right(l.t, {overlap}) || p.t')} FROM lead_in l JOIN p{last} p ON p.doc_id = l.doc_id AND p.n = l.n + 1)")
    return f"""WITH RECURSIVE {", ".join(out)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index, CAST(length(b) AS BIGINT) AS n_chars, sha256(b) AS chunk_hash
    FROM (SELECT doc_id, n, {strip("t")} AS b FROM lead_in) WHERE b <> ''"""


@query(_recursive_sql(1000, 100))
def recursive_chunks(t: Tables) -> DataFrame:
    """Cut at the coarsest separator that fits, in Arrow batches."""
    cut = t.raw("documents").select("doc_id", F.posexplode(C.recursive_chunks(1000, 100)("text")).alias("chunk_index", "chunk_text"))
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk_text").cast("long").alias("n_chars"), F.sha2("chunk_text", 256).alias("chunk_hash"))


@query(_recursive_sql(800, 0))
def recursive_chunks_lateral(t: Tables) -> DataFrame:
    """The same cutter, called from SQL, with other lengths."""
    sql_functions.register(t.spark)
    return t.spark.sql(
        "SELECT d.doc_id, c.chunk_index, CAST(length(c.chunk_text) AS BIGINT) AS n_chars, sha2(c.chunk_text, 256) AS chunk_hash FROM {docs} d, LATERAL recursive_chunks(d.text, 800, 0) c", docs=t.raw("documents")
    )


# Files and sections


@query(r"SELECT doc_id, sha256(CASE doc_id % 4 WHEN 2 THEN regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') WHEN 3 THEN text || chr(10) || 'end' ELSE text END) AS text_hash FROM documents WHERE text IS NOT NULL")
def decoded_files(t: Tables) -> DataFrame:
    """Texts as the bytes of files in UTF-8 with and without a mark, in Latin-1 and with other line ends, decoded."""
    text = F.col("text")
    content = (
        F.when(F.col("doc_id") % 4 == 0, F.encode(text, "UTF-8"))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit(files.BOM)), F.encode(text, "UTF-8")))
        .when(F.col("doc_id") % 4 == 2, F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", "?"), "ISO-8859-1"))
        .otherwise(F.encode(F.concat(F.regexp_replace(text, "\n", "\r\n"), F.lit("\rend")), "UTF-8"))
    )
    docs = t.raw("documents").where("text is not null").select("doc_id", content.alias("content"))
    return docs.select("doc_id", F.sha2(files.decoded(F.col("content")), 256).alias("text_hash"))


@query(
    rf""", s AS (SELECT doc_id, page_no, {_STRIP.format("text")} AS a, {_STRIP.format("tables")} AS b, {_STRIP.format("figures")} AS c FROM page_rows)
    SELECT doc_id, page_no, kind, sha256(x) AS section_hash FROM (
      SELECT doc_id, page_no, 'text' AS kind, CASE WHEN a = '' OR page_no % 2 = 0 THEN a ELSE a || chr(10) || chr(10) || 'again' END AS x FROM s UNION ALL SELECT doc_id, page_no, 'table', b FROM s UNION ALL SELECT doc_id, page_no, 'figure', c FROM s)
    WHERE x <> '' AND NOT (kind = 'text' AND x = '')""",
    "page_rows",
)
def tagged_sections(t: Tables) -> DataFrame:
    """Sections of pages whose blocks stand under tags, some of them twice."""
    text = F.expr("concat(CASE WHEN page_no % 3 = 1 THEN '' ELSE '## Text' END, text, ' \\n## Tables\\n', tables, '\\n## Figures', figures, CASE WHEN page_no % 2 = 1 AND trim(text) <> '' THEN ' ## Text again' ELSE '' END)")
    found = B.sections(t.pages().select("doc_id", "page_no", text.alias("text")), ["doc_id", "page_no"], {"text": "## Text", "table": "## Tables", "figure": "## Figures"})
    return found.select("doc_id", "page_no", "kind", F.sha2("text", 256).alias("section_hash"))


@query(
    """SELECT o_orderkey AS template_id, sha256('Order ' || o_orderkey || ': ' || o_orderstatus || ' {{ bad name }} ' || CASE WHEN o_orderkey % 3 = 0 THEN '（待补充）' ELSE o_orderpriority END || ' （待补充）') AS text_hash,
    'AGAIN' AS missing, CASE WHEN o_orderkey % 2 = 0 THEN 'UNUSED' ELSE '' END AS extra FROM orders"""
)
def rendered_templates(t: Tables) -> DataFrame:
    """Templates filled from payloads, with what a template names and a payload lacks, and the other way round."""
    section = "struct<key:string,text:string>"
    sections_ = F.array(
        F.struct(F.lit("STATUS").alias("key"), F.col("o_orderstatus").alias("text")),
        F.struct(F.lit("PRIORITY").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("text")),
    )
    unused = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("UNUSED").alias("key"), F.lit("x").alias("text")))).otherwise(F.array().cast(f"array<{section}>"))
    payload = F.struct(F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.lit("n").alias("doc_no"), F.concat(sections_, unused).alias("sections"), F.lit(None).cast(docgen.NOTES).alias("evidence_notes"))
    rows = t.raw("orders").select(F.col("o_orderkey").alias("template_id"), F.lit("{{TITLE}}: {{ STATUS }} {{ bad name }} {{PRIORITY}} {{ AGAIN }}").alias("template"), payload.alias("payload"))
    return docgen.render(rows).select("template_id", F.col("text_sha256").alias("text_hash"), F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))
