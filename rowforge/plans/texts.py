"""Text checks, cleaning, names and paths over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names, text
from ..sources.tables import Tables
from .registry import query

# All three text tables, each text once, as (source, id, text).
ALL_TEXTS = """
with texts as (
  select 'documents' as origin, doc_id as id, text from documents
  union all select 'pages', page_id, html from pages
  union all select 'conversations', conv_id * 1000 + turn, text from conversations
)"""

# RE2 spellings of the patterns; the data holds no letters where the dialects differ.
SQL_RE2 = (
    r"(?i)(\b(union|select|insert|update|delete|drop|create|alter|exec|execute)\b"
    r"|['\";]|--|\*|/\*|\*/)"
)
XSS_RE2 = r"(?i)(<script|<iframe|<object|<embed|javascript:|vbscript:|on\w+\s*=)"
CONTROL_RE2 = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def all_texts(t: Tables) -> DataFrame:
    conversation = (F.col("conv_id") * 1000 + F.col("turn")).alias("id")
    rows = t.spread
    return (
        rows["documents"]
        .select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        .unionByName(
            rows["pages"].select(
                F.lit("pages").alias("origin"),
                F.col("page_id").alias("id"),
                F.col("html").alias("text"),
            )
        )
        .unionByName(
            rows["conversations"].select(F.lit("conversations").alias("origin"), conversation, "text")
        )
    )


def _flag(name: str, pattern: str, check) -> None:
    sql = f"select origin, id, regexp_matches(text, {_quoted(pattern)}) as flagged from texts"

    @query(name, ALL_TEXTS + sql)
    def plan(t: Tables) -> DataFrame:
        return all_texts(t).select("origin", "id", check(F.col("text")).alias("flagged"))


_flag("flag_control_chars", CONTROL_RE2, text.has_control_chars)
_flag("flag_sql_injection", SQL_RE2, text.has_sql_injection)
_flag("flag_xss", XSS_RE2, text.has_xss)


def _digest(t: Tables, cleaned: Column) -> DataFrame:
    """Length and hash of the whole cleaned text."""
    return (
        all_texts(t)
        .select("origin", "id", cleaned.alias("cleaned"))
        .select(
            "origin",
            "id",
            F.length("cleaned").cast("long").alias("n_chars"),
            F.md5("cleaned").alias("digest"),
        )
    )


_DIGEST_SQL = "select origin, id, length(cleaned) as n_chars, md5(cleaned) as digest from cleaned"

_ESCAPED = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""


# No text in the tables has a character that only the compatibility form replaces, so
# the canonical form is the same here; tests compare the others with brute force.
@query(
    "nfkc",
    ALL_TEXTS
    + ", cleaned as (select origin, id, nfc_normalize(text) as cleaned from texts)"
    + _DIGEST_SQL,
)
def nfkc_plan(t: Tables) -> DataFrame:
    return _digest(t, text.nfkc(F.col("text")))


@query(
    "html_escape",
    ALL_TEXTS
    + f", cleaned as (select origin, id, {_ESCAPED.format('text')} as cleaned from texts)"
    + _DIGEST_SQL,
)
def html_escape_plan(t: Tables) -> DataFrame:
    return _digest(t, text.html_escape(F.col("text")))


@query(
    "squeeze_whitespace",
    ALL_TEXTS
    + r""", wide as (select origin, id, '  ' || replace(replace(text, '. ', '.            '),
         ', ', ',         ') || chr(10) as wide from texts),
       cleaned as (select origin, id, regexp_replace(regexp_replace(wide, '\s{10,}', ' ', 'g'),
         '^\s+|\s+$', '', 'g') as cleaned from wide)"""
    + _DIGEST_SQL,
)
def squeeze_whitespace_plan(t: Tables) -> DataFrame:
    # sentence ends get 12 blanks (squeezed), commas get 9 (kept)
    wide = F.replace(F.col("text"), F.lit(". "), F.lit("." + " " * 12))
    wide = F.replace(wide, F.lit(", "), F.lit("," + " " * 9))
    return _digest(t, text.squeeze_whitespace(F.concat(F.lit("  "), wide, F.lit("\n"))))


@query(
    "length_check",
    ALL_TEXTS
    + """select origin, id, case when length(text) = 0 then 'empty_after_sanitization'
         when length(text) > 100 then 'too_long' end as issue from texts""",
)
def length_check_plan(t: Tables) -> DataFrame:
    return all_texts(t).select("origin", "id", text.length_issue(F.col("text")).alias("issue"))


_CLEAN = _ESCAPED.format("text")


@query(
    "sanitize_text",
    ALL_TEXTS
    + f""", cleaned as (select origin, id, text,
         regexp_replace(regexp_replace({_CLEAN}, '\\s{{10,}}', ' ', 'g'),
           '^\\s+|\\s+$', '', 'g') as cleaned from texts),
       checked as (select *, case
           when regexp_matches(text, {_quoted(CONTROL_RE2)}) then 'control_characters'
           when regexp_matches(text, {_quoted(SQL_RE2)}) or regexp_matches(text, {_quoted(XSS_RE2)})
             then 'invalid_characters'
           when length(cleaned) = 0 then 'empty_after_sanitization'
           when length(cleaned) > 100 then 'too_long' end as issue from cleaned)
       select origin, id, issue, case when issue is null then cleaned end as value from checked""",
)
def sanitize_text_plan(t: Tables) -> DataFrame:
    checked = text.sanitize_columns(all_texts(t), {"text": F.col("text")})
    return checked.select(
        "origin", "id", F.col("text_issue").alias("issue"), F.col("text_value").alias("value")
    )


# ------------------------------------------------------------- names and paths


@query(
    "doc_id_from_path",
    "select page_id, split_part(url, '/', -1) as id from pages",
)
def doc_id_from_path_plan(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", names.doc_id_from_path(F.col("url")).alias("id"))


_NAMES = """
with names as (
  select 'part' as origin, p_partkey as id, p_name as name from part
  union all select 'customer', c_custkey, c_name from customer
  union all select 'pages', page_id, url from pages
  union all select 'pages_trimmed', page_id, ' ' || replace(replace(url, '?', ''), '&', '') from pages
  union all select 'orders', o_orderkey, '..' || o_orderpriority from orders
)"""


def _name_rows(t: Tables) -> DataFrame:
    url = F.col("url")
    bare = F.replace(F.replace(url, F.lit("?"), F.lit("")), F.lit("&"), F.lit(""))
    rows = [
        ("part", "part", F.col("p_partkey"), F.col("p_name")),
        ("customer", "customer", F.col("c_custkey"), F.col("c_name")),
        ("pages", "pages", F.col("page_id"), url),
        ("pages_trimmed", "pages", F.col("page_id"), F.concat(F.lit(" "), bare)),
        ("orders", "orders", F.col("o_orderkey"), F.concat(F.lit(".."), F.col("o_orderpriority"))),
    ]
    frames = [
        t[table].select(F.lit(origin).alias("origin"), key.alias("id"), name.alias("name"))
        for origin, table, key, name in rows
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


@query(
    "valid_collection_name",
    _NAMES
    + """select origin, id, case when trim(name) = '' then 'empty'
         when contains(name, '..') then 'traversal'
         when regexp_matches(name, '[?#&]') then 'url_characters'
         when contains(name, '/') then 'separator' end as issue from names""",
)
def valid_collection_name_plan(t: Tables) -> DataFrame:
    issue = names.collection_name_issue(F.col("name"))
    return _name_rows(t).select("origin", "id", issue.alias("issue"))


@query(
    "valid_document_path",
    _NAMES
    + """, paths as (select origin, id, case when origin in ('part', 'customer')
           then origin || '/' || name || case when id % 2 = 0 then '/more' else '' end
           else name end as path from names),
       split as (select *, string_split(trim(path), '/') as parts from paths)
       select origin, id, case when trim(path) = '' then 'empty'
         when contains(path, '..') then 'traversal'
         when regexp_matches(path, '[?#&]') then 'url_characters'
         when len(parts) < 2 or len(parts) % 2 <> 0 then 'odd_segments'
         when list_contains(list_transform(parts, lambda p: trim(p)), '') then 'empty_segment'
         end as issue from split""",
)
def valid_document_path_plan(t: Tables) -> DataFrame:
    more = F.when(F.col("id") % 2 == 0, "/more").otherwise("")
    path = F.when(
        F.col("origin").isin("part", "customer"),
        F.concat(F.col("origin"), F.lit("/"), F.col("name"), more),
    ).otherwise(F.col("name"))
    rows = _name_rows(t).withColumn("path", path)
    return rows.select(
        "origin", "id", names.document_path_issue(F.col("path")).alias("issue")
    )
