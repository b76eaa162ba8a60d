"""The registered query of each operator, next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontaminate, line_dedup, main_text, merkle, packing, quality_model, quality_rules, secrets, simhash, substring_dedup, token_counts
from .common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end"


@query("op1_line_dedup", rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as no from documents),
  full_ as (select *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as s, len({_WORDS.format('line')}) as w from l),
  n as (select *, row_number() over (partition by doc_id order by no) as i, sum(w) over (partition by doc_id order by no) as upto from full_ where w > 0),
  d as (select doc_id, list(s order by i) as ls, list(upto order by i) as u, count(*) as n_lines from n group by doc_id),
  r as (select doc_id, i, i + k as e, array_to_string(ls[i:i+k], chr(10)) as key
    from (select doc_id, ls, u, n_lines, unnest(range(1, n_lines + 1)) as i from d), (select unnest(range(0, 8)) as k)
    where i + k <= n_lines and u[i + k] - coalesce(u[i - 1], 0) >= 1),
  f as (select *, first_value(doc_id) over p as d0, first_value(i) over p as i0 from r window p as (partition by key order by doc_id, i)),
  gone as (select distinct doc_id, unnest(range(i, e + 1)) as i from f where doc_id > d0 or i > i0),
  kept as (select full_.doc_id, full_.no, full_.line, full_.w, gone.i is not null as out
    from full_ left join n using (doc_id, no) left join gone on gone.doc_id = n.doc_id and gone.i = n.i)
select doc_id, count(*) filter (w > 0) as n_lines, count(*) filter (out) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (not out), '')) as kept_sha256
from kept group by doc_id""")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = line_dedup.dedup_lines(docs, min_words=1, removed="n_removed")
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return kept.select("doc_id", (F.size(lines) + F.col("n_removed")).cast("long").alias("n_lines"), "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_ESCAPES = "len(regexp_extract_all({}, '\\x10|<\\||<s>|</s>|<<SYS>>|<</SYS>>|<start_of_turn>|<end_of_turn>|\\[/?INST\\]'))"


@query("op2_chat_format", rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(role) + length(text) + {_ESCAPES.format('role')} + {_ESCAPES.format('text')}) as bigint) as formatted_chars
from t group by conv_id""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(fixed)))


@query("op3_decontaminate", rf"""
with d as (select doc_id, {_WORDS.format(_LOWER)} as w from documents), b as (select item_id, {_WORDS.format(_LOWER)} as w from benchmark),
  ds as (select doc_id, unnest({_SHINGLES}) as s from d), bs as (select item_id, unnest({_SHINGLES}) as s from b),
  n as (select item_id, count(*) as n_shingles from bs group by item_id)
select doc_id, item_id, n_shingles, count(*) as n_shared from ds join bs using (s) join n using (item_id)
group by doc_id, item_id, n_shingles having count(*) >= 0.8 * n_shingles""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"))


@query("op4_substring_dedup", rf"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
  x as (select doc_id, s, array_to_string(w[s:s+49], ' ') as key from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50)),
  f as (select doc_id, s, min(doc_id) over (partition by key) as d0 from x),
  gone as (select distinct doc_id, unnest(range(s, s + 50)) as i from f where doc_id > d0),
  words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
  kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by i) as t from words anti join gone using (doc_id, i) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_simhash_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op6_main_text")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    pages = main_text.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query("op9_quality_model")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = quality_model.score(docs.select("doc_id", "text"), quality_model.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op10_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op11_collocations", rf"""
with p as (select coalesce(lang, 'und') as lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
    select lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece from documents)),
  o as (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z from (select lang, w, unnest(range(1, len(w) + 1)) as i from p)),
  n as (select lang, count(*) as n from o group by lang),
  f as materialized (select lang, 1 as size, x as phrase, x, null as y, null as z, count(*) as a from o group by lang, x
    union all select lang, 2, x || ' ' || y, x, y, null, count(*) from o where y is not null group by lang, x, y
    union all select lang, 3, x || ' ' || y || ' ' || z, x, y, z, count(*) from o where z is not null group by lang, x, y, z),
  c as materialized (select lang, phrase, size, a, 1 as k, x as l, case when size = 2 then y else y || ' ' || z end as r from f where size > 1 and a >= 10
    union all select lang, phrase, size, a, 2, x || ' ' || y, z from f where size = 3 and a >= 10),
  often as materialized (select lang, phrase, a from f where a >= 10),
  cuts as (select c.lang, c.phrase, c.size, c.a, c.k, lf.a as l, rf.a as r,
      cast((1000000::hugeint * c.a * c.a) // (lf.a::hugeint * rf.a) as bigint) as score
    from c join often lf on lf.lang = c.lang and lf.phrase = c.l join often rf on rf.lang = c.lang and rf.phrase = c.r),
  weakest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
  longer as (select lang, phrase, max(a) as most from (
      select lang, x || ' ' || y as phrase, a from f where size = 3 and a >= 10 union all select lang, y || ' ' || z, a from f where size = 3 and a >= 10)
    group by lang, phrase),
  kept as (select w.* from weakest w left join longer using (lang, phrase) where size = 3 or most is null or 100 * most < 50 * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join n using (lang) qualify rank <= 2000""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents").select("lang", "text"))


def _merkle_sql(levels: int = 5, source_levels: int = 4) -> str:
    """Sixteen to the powers given bound the rows of a source and the sources."""
    fold = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda c, b: {fold}), 4294967295)"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(name: str, n: int, group: str) -> list[str]:
        out = []
        for k in range(n):
            sides = [f"coalesce(string_agg(h, '') over (partition by {group}, pos // 16 order by pos rows between {x}), '') as {s}" for s, x in (("lt", "unbounded preceding and 1 preceding"), ("rt", "1 following and unbounded following"))]
            out.append(f"{name}n{k} as (select *, {', '.join(sides)} from {name}{k})")
            out.append(f"{name}{k + 1} as (select {group}, pos // 16 as pos, (n + 15) // 16 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h from {name}{k} group by {group}, pos // 16, n)")
        return out

    def go(walk: str, name: str, n: int, group: str, start: str) -> list[str]:
        out = [f"{walk}0 as ({start})"]
        for k in range(n):
            out.append(f"""{walk}{k + 1} as (select w.* replace (w.pos // 16 as pos, case when x.n = 1 then cur else sha256(x.lt || cur || x.rt) end as cur, case when x.n = 1 then proof else proof || x.lt || x.rt end as proof)
  from {walk}{k} w join {name}n{k} x on w.{group} is not distinct from x.{group} and w.pos = x.pos)""")
        return out

    parts = [
        f"d as (select doc_id, source, {leaf('text')} as leaf, case when {crc} % 5 = 0 then {leaf('low')} end as bad from (select *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents))",
        "d0 as (select *, row_number() over (partition by source order by doc_id nulls last, leaf) - 1 as pos from d)",
        "t0 as (select source, pos, count(*) over (partition by source) as n, leaf as h from d0)",
        *climb("t", levels, "source"),
        f"s0 as (select 0 as one, source, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n, h from t{levels})",
        *climb("s", source_levels, "one"),
        *go("w", "t", levels, "source", "select *, coalesce(bad, leaf) as cur, '' as proof from d0"),
        *go("v", "s", source_levels, "one", f"select 0 as one, w.doc_id, w.leaf, s0.h as subroot, s0.pos, w.cur, w.proof from w{levels} w join s0 on w.source is not distinct from s0.source"),
    ]
    return "with " + ",\n".join(parts) + f"\nselect doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, cur as folded_root, cur = h as verified from v{source_levels}, s{source_levels}"


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_secret_scan")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
