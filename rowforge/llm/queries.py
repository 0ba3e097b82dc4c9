"""The registered queries of this subpackage and the SQL they must agree with.

A query applies its operator to a whole table and derives the agreed columns from it.
"""

from __future__ import annotations

from collections.abc import Callable
from textwrap import dedent

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    chat, embedding_dedup, language, lm, mixing, neardup, packing, periodic, prefix_trie, quality, secrets, warc, wrappers
)
from ..session import durable
from .common import read, spread_scan, words

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = dedent(sql).strip()
        return run

    return register


def _in(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


_RULES_SQL = " and ".join(
    f"100 * {rule.figure} {sign} {bound} * {rule.base}"
    for rule in quality.RULES
    for sign, bound in ((">=", rule.low), ("<=", rule.high))
    if bound is not None
)


@query(
    "op2_quality_rules",
    rf"""
    with texts as (
      select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
    ),
    split_words as (
      select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
      from texts
    ),
    positions as (
      select r, w, unnest(range(1, len(w) - 1)) as i from split_words where len(w) >= 3
    ),
    windows as (
      select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from positions
    ),
    covered as (
      select r, count(distinct i + k) as n
      from windows cross join (values (0), (1), (2)) as o(k) where n >= 2 group by r
    ),
    figures as (
      select doc_id, cast(len(w) as bigint) as n_words,
        cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
        cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
        cast(coalesce(n, 0) as bigint) as n_repeat_words,
        cast(len(l) as bigint) as n_lines,
        cast(len(list_filter(w, lambda x: lower(x) in ({_in(quality.STOP_WORDS)}))) as bigint) as n_stop_words
      from texts join split_words using (r) left join covered using (r)
    ),
    judged as (
      select *, n_words < {quality.MIN_WORDS}
          or 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words as base_failed
      from figures
    )
    select *, not base_failed and {_RULES_SQL} as kept from judged
    """,
)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document under the production thresholds."""
    docs = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.quality(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    return judged.select("row.doc_id", *[F.col(f"q.{n}") for n in names], "q.base_failed", "q.kept")


_WEIGHT_SQL = "case (rank % 3) " + " ".join(
    f"when {i} then {w}" for i, w in enumerate(mixing.WEIGHTS)
) + " end"


@query(
    "op6_mix_weighted_fair",
    rf"""
    with sized as (
      select doc_id, source is null as no_source, coalesce(source, '') as src,
        cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
        md5(coalesce(cast(doc_id as varchar), '')) as turn
      from documents
    ),
    sources as (
      select *, row_number() over (order by no_source, src) - 1 as rank
      from (select no_source, src, cast(sum(size) as bigint) as source_size from sized group by 1, 2)
    ),
    weighted as (select *, {_WEIGHT_SQL} as weight from sources),
    budget as (select {mixing.BUDGET}e0 * sum(size) as words from sized),
    levels as (
      select (words - coalesce(sum({mixing.MAX_REPEATS} * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
          / sum(weight) over (o rows between current row and unbounded following) as level,
        {mixing.MAX_REPEATS} * source_size as cap, weight, cap / weight as fills_at
      from weighted cross join budget window o as (order by 2 * source_size / weight, rank)
    ),
    level as (select coalesce((select level from levels where cap >= level * weight order by fills_at limit 1), 1e300) as level),
    targets as (
      select *, least(level * weight, cast({mixing.MAX_REPEATS} * source_size as double)) as target
      from weighted cross join level
    ),
    handed as (
      select doc_id, size, source_size, rank, target,
        sum(size) over (partition by no_source, src order by turn, doc_id, size rows unbounded preceding) as handed
      from sized join targets using (no_source, src)
    ),
    turns as (
      select doc_id, size, rank, (source_size * r + handed) / target as finish
      from handed cross join range({mixing.MAX_REPEATS}) as x(r) where size > 0
    ),
    merged as (
      select doc_id, sum(size) over (order by finish, rank rows unbounded preceding) <= words as taken
      from turns cross join budget
    ),
    copies as (select doc_id, count(*) as n from merged where taken group by doc_id)
    select doc_id, size, source_size, target, cast(coalesce(n, 0) as int) as copies,
      cast(size * coalesce(n, 0) as bigint) as taken
    from handed left join copies using (doc_id)
    """,
)
def mix_weighted_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    docs = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixing.mix(docs)


@query("op5_pack_best_fit")
def pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op7_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and group of every document."""
    found = neardup.near_duplicates(spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.drop("digest")


@query("op9_embedding_near_duplicates")
def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and group of every embedding."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op1_language_centroids")
def language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 3, 1)
    model = language.train(docs.where(~held))
    found = language.identify(spread_scan(docs.select("doc_id", "text")), model)
    return found.select("row.doc_id", "l.*").withColumn("held_out", held)


@query("op10_lm_bloom_levels")
def lm_bloom_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of six sevenths of them."""
    docs = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("held_out", language.held_out(F.col("doc_id"), 7, 2))
    model, words = lm.train(docs.where("not held_out"))
    return lm.score(docs, model, words)


@query(
    "op3_warc_members",
    """
    with sized as (
      select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
        sha256(coalesce(html, '')) as payload_digest
      from pages
    ),
    firsts as (select *, min(page_id) over (partition by payload_digest) as first_id from sized),
    typed as (
      select *, payload_bytes >= 100 and page_id <> first_id as again from firsts
    )
    select page_id, payload_bytes, payload_digest,
      case when again then 'revisit' else 'response' end as record_type,
      case when again then first_id end as refers_to
    from typed
    """,
)
def warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as its record in the normalised archives says."""
    pages = spread_scan(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = warc.read_archives(warc.archive_pages(spark, pages))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_html_wrappers")
def html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, read through the wrapper of its host."""
    return wrappers.main_text(spread_scan(read(spark, sf_dir, "pages").select("page_id", "url", "html")))


#: The one tool of conversations in prose.
REPLY = {"reply": chat.Tool(required={"prompt": "string", "turn": "integer"})}


@query(
    "op8_chat_tool_links",
    """
    with calls as (
      select *, row_number() over (partition by conv_id, turn order by text) as again
      from conversations where role = 'user'
    ),
    results as (
      select conv_id, turn - 1 as turn, min(text) as content, count(*) as n
      from conversations where role = 'assistant' group by 1, 2
    ),
    linked as (
      select c.*, r.content, coalesce(r.n, 0) as n_results,
        conv_id || ':' || turn as call_id,
        turn >= 2 and not exists (
          from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2) as unmet
      from calls c left join results r using (conv_id, turn)
    )
    select conv_id, turn, row_number() over (partition by conv_id order by turn, text) as position,
      call_id, 'reply' as tool,
      case when again > 1 then 'repeated' when n_results > 0 then 'answered' else 'pending' end as status,
      n_results, cast(unmet as bigint) as n_unmet, false as cyclic, text is not null as valid,
      case when text is null then 'missing:prompt' else '' end as errors,
      '{"call":{"arguments":{' || case when text is null then '' else '"prompt":' || to_json(text) || ',' end
        || '"turn":' || turn || '},"id":' || to_json(call_id) || ',"name":"reply"},"errors":['
        || case when text is null then '"missing:prompt"' else '' end || ']'
        || case when n_results > 0 then ',"result":{' || case when content is null then '' else '"content":' || to_json(content) || ',' end
             || '"turn":' || (turn + 1) || '}' else '' end
        || '}' as message
    from linked
    """,
)
def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of a conversation with its answer, as a linked and validated call."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    linked = chat.link_calls(*chat.exchanges(turns), REPLY)
    return linked.withColumnRenamed("conversation", "conv_id").drop("place")


def _placed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


@query("op11_secret_spans")
def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and places of the secrets of every document."""
    docs = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [kind.name for kind in secrets.BASE_KINDS]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return secrets.scan_secrets(docs).select(
        "row.doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        F.sha2(_placed(of(*base)), 256).alias("base_sha256"),
        _placed(F.col("spans")).alias("spans"),
    )


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; where the checksum of the id ends in 0, words repeat from a place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = F.coalesce(h % 10 == 0, F.lit(False))
    # words of other texts are not split here
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(planted, words(F.col("text"))).alias("w"))
    n = F.size("w").cast("long")
    docs = docs.withColumn("a", F.when(n > 0, F.col("g") % n))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(
        "w",
        lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x),
    )
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, its longest one, and the text without repeats."""
    docs = spread_scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.periodic_runs(_with_planted_runs(docs)).select("row.doc_id", "p.runs", "p.collapsed")
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    )
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.n")).alias("length"),
        F.col("longest.period").alias("period"),
        F.floor(-1000 * F.col("longest.n") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_borrowed_turns(keys: DataFrame, conversations: DataFrame) -> DataFrame:
    """The turns of rebuilt conversations: the first ones are those of another one."""
    heads_of, taken = F.col("conv") - F.col("conv") % 20, (F.crc32(F.col("conv").cast("string")) % 4).cast("int")
    heads = keys.where((F.col("conv") % 20 == 0) & (F.col("place") < 3)).withColumnRenamed("conv", "head")
    lengths = heads.groupBy("head").agg(F.count("*").alias("there"))
    plan = conversations.select("conv", heads_of.alias("head"), taken.alias("taken")).join(lengths, "head", "left")
    plan = durable(plan.withColumn("found", F.least("taken", F.coalesce("there", F.lit(0)))))
    borrowed = plan.join(heads, "head").where("place < found").select("conv", "place", "key", "words")
    # where the other conversation is too short, own turns move up
    short = plan.where("found < taken").select("conv", (F.col("taken") - F.col("found")).alias("less"))
    own = keys.where(F.col("place") >= taken).join(short, "conv", "left")
    return borrowed.unionByName(own.select("conv", (F.col("place") - F.coalesce("less", F.lit(0))).alias("place"), "key", "words"))


@query("op13_prefix_trie")
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    keys = durable(prefix_trie.turn_keys(turns))
    conversations = durable(turns.where("conv_id is not null").select(F.col("conv_id").alias("conv")).distinct())
    rebuilt = durable(_with_borrowed_turns(keys, conversations))
    nodes, ends = prefix_trie.trie_of_keys(rebuilt, conversations)
    figures = [c for c in nodes.columns if c != "end_key"]
    hashed = nodes.where("end_key is not null").join(prefix_trie.hashed_ends(ends), "end_key")
    passed = nodes.where("end_key is null").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    return hashed.select(*figures, "ends_sha256").unionByName(passed.select(*figures, "ends_sha256"))
