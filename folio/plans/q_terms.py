"""Queries over profiling, terminology, layout plans and page choice, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import automaton
from ..functions import text as T
from ..operators import chunking, columns, layout, overlay, profile, qa, terms
from ..sources import markdown
from ..sources.lens import BLOCKS_SQL, read_blocks, table
from ..streaming import incremental
from .q_chunks import _chunks
from .q_overlay import CELLS, SPANS, cells, spans
from .q_text import STRIPPED

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CHARS = "pc as (select doc, page, cast(sum(length(text)) as bigint) as chars from blocks group by 1, 2)"


@query(f"""with {BLOCKS_SQL}, {CHARS}, n as (select doc, max(page) as n from pc group by 1), s as (select pc.* from pc join n using (doc) where (page - 1) % greatest(1, n // 40) = 0)
select doc, count(*) as sampled, count(*) filter (chars < 20) as empty, case when count(*) filter (chars < 20) * 2 > count(*) then 'scanned' when count(*) filter (chars < 20) > 0 then 'mixed' else 'native' end as verdict from s group by 1""")
def q_text_layer(spark, sf_dir):
    chars = read_blocks(spark, sf_dir).groupBy("doc", "page").agg(F.sum(F.length("text")).cast("long").alias("chars"))
    return profile.text_layer(chars)


@query("""with x as (select page_id as doc, page_id % 3 + 1 as page, case when page_id % 4 = 0 then 1.0 else 0.2 end as off from pages) select doc, count(*) as affected, cast(min(page) as varchar) as samples from x where off > 0.5 group by 1""")
def q_box_check(spark, sf_dir):
    box = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), (F.col("page_id") % 3 + 1).alias("page"), *[F.lit(v).alias(f"media_{c}") for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 612.0), ("y1", 792.0))],
                                             F.when(F.col("page_id") % 4 == 0, 1.0).otherwise(0.2).alias("crop_x0"), F.lit(0.0).alias("crop_y0"), F.lit(612.0).alias("crop_x1"), F.lit(792.0).alias("crop_y1"))
    return profile.box_mismatch(box).select("doc", "affected", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("select page_id as doc, len(regexp_extract_all(html, '<(?:div|p)[ >]')) as n_open, len(regexp_extract_all(html, '</(?:div|p)>')) as n_close, len(regexp_extract_all(html, '<(?:div|p)[ >]')) = len(regexp_extract_all(html, '</(?:div|p)>')) as balanced from pages where html is not null")
def q_balance_check(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    return profile.operator_balance(rows, "<(?:div|p)[ >]", "</(?:div|p)>")


# some of them mean something inside a character class
_SUSPECT = {"é": "e", "ñ": "n", "^": "up", "ß": "ss", "]": "right", "-": "dash", "ç": "c"}


@query("with c as (select unnest(regexp_extract_all(text, '[éñ^ßç\\]-]')) as ch from documents) select ch, count(*) as n, case ch when 'é' then 'e' when 'ñ' then 'n' when '^' then 'up' when 'ß' then 'ss' when ']' then 'right' when '-' then 'dash' else 'c' end as stands_for from c group by 1")
def q_ligature_audit(spark, sf_dir):
    return profile.character_audit(table(spark, sf_dir, "documents"), _SUSPECT)


@query("select page_id % 10 as doc, array_to_string(list_sort(list(distinct 'Brand' || page_id % 30))[1:10], ',') as names from pages where page_id % 3 = 0 group by 1")
def q_logo_fonts(spark, sf_dir):
    k = F.col("page_id")
    fonts = table(spark, sf_dir, "pages").select((k % 10).alias("doc"), F.when(k % 3 == 0, F.concat(F.lit("Brand"), (k % 30).cast("string"))).otherwise("Times").alias("name"), F.lit("TrueType").alias("ftype"))
    return profile.suspect_fonts(fonts).select("doc", F.array_join("names", ",").alias("names"))


# spans of a source's pages: short lines, of which those with a license name recur
WM = f"wm as (select d.source as doc, d.doc_id as page, d.doc_id * 100000 + b.ord as ord, {STRIPPED.format(t='b.text')} as text from blocks b join documents d on b.doc = d.doc_id)"


@query(f"""with {BLOCKS_SQL}, {WM}, r as (select *, regexp_replace(text, '[0-9]+', '#', 'g') as mask from wm where length(text) > 3 and length(text) < 80),
m as (select doc, text, count(*) as n from r group by doc, mask, text qualify row_number() over (partition by doc, mask order by count(*) desc, min(ord)) = 1),
p as (select doc, max(page) as all_pages from wm group by 1), h as (select m.*, all_pages from m join p on m.doc = p.doc where n >= greatest(3.0, all_pages * 0.0) and regexp_matches(text, '(?i)license|les|der')),
s as (select r.doc, r.text, count(distinct page) as pages, min(ord) as seen from r group by 1, 2)
select h.doc, h.text, n as occurrences, pages, n / all_pages as frac from h join s on h.doc = s.doc and h.text = s.text qualify row_number() over (partition by h.doc order by n desc, seen) <= 10""")
def q_watermark(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source"))
    rows = read_blocks(spark, sf_dir).join(docs, "doc").select(F.col("source").alias("doc"), F.col("doc").alias("page"), (F.col("doc") * 100_000 + F.col("ord")).alias("ord"), "text")
    from dataclasses import replace

    from ..config import DEFAULT

    return profile.watermarks(rows, "(?i)license|les|der", share=0.0, cfg=replace(DEFAULT, watermark_min_count=3))


@query(f"with {BLOCKS_SQL}, {WM}, t as (select doc, left(text, 40) as text, count(*) as n, min(ord) as seen from wm where length(text) % 2 = 0 group by 1, 2 qualify row_number() over (partition by doc order by count(*) desc, min(ord)) <= 5) select doc, text, n from t where n >= 5")
def q_rotated_top(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source"))
    rows = read_blocks(spark, sf_dir).join(docs, "doc").select(F.col("source").alias("doc"), (F.col("doc") * 100_000 + F.col("ord")).alias("ord"), "text", (F.length("text") % 2 == 0).alias("rotated"))
    return profile.rotated_top(rows, least=5)


_SCORE = "sc as (select page_id % 10 as doc, page_id as page, len(regexp_extract_all(html, '<div')) * 2 + len(regexp_extract_all(html, '<(?:img|script)')) * 3 + len(list_filter(string_split(html, chr(10)), lambda x: length(x) <= 12)) as score from pages where html is not null)"


def _scores(spark, sf_dir):
    h = F.col("html")
    short = F.size(F.filter(F.split(h, "\n", -1), lambda x: F.length(x) <= 12))
    rows = table(spark, sf_dir, "pages").where(h.isNotNull()).select((F.col("page_id") % 10).alias("doc"), F.col("page_id").alias("page"), F.regexp_count(h, F.lit("<div")).alias("drawings"), F.regexp_count(h, F.lit("<(?:img|script)")).alias("images"), short.alias("short_lines"))
    return qa.page_scores(rows)


@query(f"with {_SCORE} select doc, page, cast(score as bigint) as score from sc")
def q_page_complexity(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(f"""with recursive {_SCORE}, r as (select doc, page, row_number() over (partition by doc order by score desc, page desc) as i from sc where score > 0),
pick as (select doc, i, [page] as got from r where i = 1 union all select p.doc, r.i, case when len(p.got) < 4 and len(list_filter(p.got, lambda q: abs(q - r.page) <= 2)) = 0 then list_append(p.got, r.page) else p.got end from pick p join r on r.doc = p.doc and r.i = p.i + 1),
f as (select doc, got from pick qualify row_number() over (partition by doc order by i desc) = 1)
select doc, cast(unnest(got) as int) as page, cast(unnest(range(len(got))) as int) as pick from f""")
def q_page_pick(spark, sf_dir):
    return qa.page_pick(_scores(spark, sf_dir), 4)


@query("""with w as (select regexp_extract_all(lower(text), '\\pL+') as w from documents), g as (select unnest([2, 3, 4]) as size, w from w),
e as (select size, array_to_string(list_slice(w, i, i + size - 1), ' ') as gram from (select size, w, unnest(range(1, len(w) - size + 2)) as i from g))
select cast(size as int) as size, gram, count(*) as n from e where not regexp_matches(gram, '^(?:the|of) | (?:the|of)$') group by 1, 2 having count(*) >= 20""")
def q_ngrams(spark, sf_dir):
    return terms.ngrams(table(spark, sf_dir, "documents"), stop=("the", "of"), least=20)


@query(f"with {BLOCKS_SQL}, a as (select doc, page, ord, text, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[^\\pL0-9_]+', ' ', 'g'), '[\\pL0-9_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,}}[0-9]*'))) as acronym from blocks) select doc, acronym, count(*) as n, min_by(page, ord) as page, min(ord) as ord, min_by(left(text, 40), ord) as sample from a where acronym not in ('THE') group by 1, 2")
def q_acronyms(spark, sf_dir):
    return terms.acronyms(read_blocks(spark, sf_dir), stop=("THE",))


_DEF = r"^([A-Z][a-z]+) (?:is|en|la|der) ([a-zé]+)"


@query(f"with {BLOCKS_SQL} select doc, ord, regexp_extract(text, '{_DEF}', 1) as term, regexp_extract(text, '{_DEF}', 2) as meaning from blocks where regexp_matches(text, '{_DEF}')")
def q_definitions(spark, sf_dir):
    return terms.definitions(read_blocks(spark, sf_dir), _DEF)


@query("""with s as (select doc_id as doc, unnest([{'d': 'de', 's': len(regexp_extract_all(text, ' der ')) * 2 + len(regexp_extract_all(text, ' und ')) * 3}, {'d': 'en', 's': len(regexp_extract_all(text, ' the ')) * 2}, {'d': 'fr', 's': len(regexp_extract_all(text, ' de ')) * 2}]) as x from documents where text is not null),
r as (select doc, x.d as domain, cast(x.s as bigint) as score, rank() over (partition by doc order by x.s desc) as r from s) select doc, domain, score, count(*) over (partition by doc) > 1 as tied from r where r = 1 and score > 0""")
def q_domain_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), "text")
    return terms.domain_vote(docs, {"de": [(" der ", 2), (" und ", 3)], "en": [(" the ", 2)], "fr": [(" de ", 2)]})


# a text as a log: every word, cut short, with the word behind it as its translation
LOG = """pair as (select source, doc_id, ws, unnest(range(1, len(ws))) as i from (select source, doc_id, string_split(text, ' ') as ws from documents where text is not null)),
log as (select source as doc, left(ws[i], 4) as term, ws[i + 1] as zh, doc_id * 100000 + i as seq, doc_id % 2 as lane from pair)"""


def log(spark, sf_dir):
    ws = F.split("text", " ", -1)
    pair = F.explode(F.transform(F.arrays_zip(ws.alias("a"), F.slice(ws, F.lit(2), F.size(ws)).alias("b")), lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), (i + 1).alias("i"))))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", "doc_id", pair.alias("x")).where("x.b is not null")
    return rows.select(F.col("source").alias("doc"), F.left("x.a", F.lit(4)).alias("term"), F.col("x.b").alias("zh"), (F.col("doc_id") * 100_000 + F.col("x.i")).alias("seq"), (F.col("doc_id") % 2).alias("lane"))


@query(f"with {LOG} select doc, term, min_by(zh, seq) as first, count(distinct zh) as n_variants from log group by 1, 2 having count(distinct zh) > 1")
def q_term_conflicts(spark, sf_dir):
    return terms.conflicts(log(spark, sf_dir))


@query(f"with {LOG} select doc, term, min_by(zh, seq) as zh from log group by 1, 2")
def q_merged_logs(spark, sf_dir):
    return incremental.merged_logs(log(spark, sf_dir))


@query(f"with {LOG} select term, min_by(zh, seq) as zh, count(*) as n from log where term not in (select p_type from part where p_type is not null) and term not like 'A%' group by 1 having count(*) >= 3")
def q_term_backfill(spark, sf_dir):
    rows = log(spark, sf_dir)
    return terms.backfill(rows, rows.where("term like 'A%'"), 3)


# words of a language as its industry's terms, long ones from a second source too
GLOSS = """gw as (select lang as industry, w as term, count(*) as n from (select lang, unnest(string_split(text, ' ')) as w from documents where text is not null and lang is not null) where w <> '' group by 1, 2),
gl as (select term, industry, case length(term) % 3 when 0 then 'verified' when 1 then 'consistent' else 'original' end as tier, cast(n % 5 as int) as source_rank, lower(term) as zh, n from gw
 union all select term, industry, 'consistent', 1, 'c' || term, cast(3 as bigint) from gw where length(term) > 7)"""


def glossary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("text is not null and lang is not null").select(F.col("lang").alias("industry"), F.explode(F.split("text", " ", -1)).alias("term")).where("term <> ''")
    n = words.groupBy("industry", "term").agg(F.count("*").alias("n"))
    k = F.length("term") % 3
    a = n.select("term", "industry", F.when(k == 0, "verified").when(k == 1, "consistent").otherwise("original").alias("tier"), (F.col("n") % 5).cast("int").alias("source_rank"), F.lower("term").alias("zh"), "n")
    return a.unionByName(n.where(F.length("term") > 7).select("term", "industry", F.lit("consistent").alias("tier"), F.lit(1).alias("source_rank"), F.concat(F.lit("c"), "term").alias("zh"), F.lit(3).cast("long").alias("n")))


@query(f"with {GLOSS} select * from gl qualify row_number() over (partition by industry, term order by case tier when 'verified' then 0 when 'consistent' then 1 else 2 end, source_rank, zh) = 1")
def q_glossary_best(spark, sf_dir):
    return terms.best_terms(glossary(spark, sf_dir))


@query(f"with {GLOSS}, lib as (select * from gl where n < 12), new as (select * from gl where n >= 3) select * from lib union all select * from new where not exists (select 1 from lib where lib.industry = new.industry and lib.term = new.term)")
def q_glossary_merge(spark, sf_dir):
    g = glossary(spark, sf_dir)
    return terms.merge_glossary(g.where("n < 12"), g.where("n >= 3"))


@query(f"with {GLOSS}, r as (select *, row_number() over (partition by industry order by n desc, term) as r from gl) select industry, avg(case when tier = 'verified' then 1.0 else 0.0 end) as share, avg(case when tier = 'verified' then 1.0 else 0.0 end) >= 0.7 as passed from r where r <= 50 group by 1")
def q_verified_share(spark, sf_dir):
    return terms.verified_share(glossary(spark, sf_dir))


@query(f"with {BLOCKS_SQL} select doc, id, 'en' as variant from blocks where contains(replace(replace(text, 'ten', ''), 'ment', ''), 'en') union all select doc, id, 'xy' from blocks where contains(text, 'xy')")
def q_term_drift(spark, sf_dir):
    return terms.drift(read_blocks(spark, sf_dir), {"en": ("ten", "ment"), "xy": ()})


# the glossary: all words of four letters or more of the benchmark, some thousands
_GLOSSARY = "gs as (select distinct unnest(regexp_extract_all(text, '[\\pL]{4,}')) as term from benchmark)"
_RUNS = "regexp_extract_all(text, '[\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+|[^\\pL\\pM\\p{Nd}\\p{Nl}\\p{Pc}]+')"


def _benchmark_terms(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), F.lit(0))).alias("term"))
    return automaton.from_table(words.withColumn("to", F.concat(F.lit("<"), "term", F.lit(">"))), to="to")


@query(f"""with {BLOCKS_SQL}, {_GLOSSARY}, r as (select doc, id, unnest({_RUNS}) as t, unnest(range(len({_RUNS}))) as i from blocks)
select doc, id, string_agg(case when gs.term is not null then '<' || t || '>' else t end, '' order by i) as text from r left join gs on gs.term = t group by 1, 2""")
def q_glossary_apply(spark, sf_dir):
    """Every glossary word of every block replaced, in one pass."""
    rows = read_blocks(spark, sf_dir).select("doc", "id", "text")
    return terms.apply_glossary(rows, _benchmark_terms(spark, sf_dir))


@query(f"with {BLOCKS_SQL}, {_GLOSSARY}, r as (select doc, id, unnest(regexp_extract_all(text, '[\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+')) as t from blocks) select doc, t as term, count(*) as n from r join gs on gs.term = t group by 1, 2")
def q_glossary_marks(spark, sf_dir):
    """How often each glossary word stands in each document."""
    found = terms.marked_terms(read_blocks(spark, sf_dir), _benchmark_terms(spark, sf_dir))
    return found.groupBy("doc", "term").agg(F.count("*").alias("n"))


@query("with w as (select unnest(regexp_extract_all(text, '[\\pL0-9_]+')) as x from documents) select * from (values ('the', (select count(*) from w where x = 'the'), (select count(*) from w where x = 'of')), ('is', (select count(*) from w where x = 'is'), (select count(*) from w where x = 'it'))) as t(verb, n_source, n_output)")
def q_modal_verbs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("text", F.col("text").alias("zh"))
    return terms.modal_counts(rows, {"the": "of", "is": "it"})


# the abbreviation stands on the second line of every third block
_HAS = "regexp_matches(text, '(^|[^\\pL0-9_])MIT([^\\pL0-9_]|$)')"


@query(f"""with {BLOCKS_SQL}, t as (select doc, ord, case when ord % 3 = 2 then 'A line' || chr(10) || text else text end as text from blocks), h as (select *, coalesce(max(case when {_HAS} then 1 end) over (partition by doc order by ord rows between unbounded preceding and 1 preceding), 0) = 1 as seen from t)
select doc, ord, case when not seen and {_HAS} then regexp_replace(text, '(?s)^(.*?(?:^|[^\\pL0-9_]))MIT([^\\pL0-9_]|$)', '\\1$1 \\\\ Institute (MIT)\\2') else text end as text from h where contains(text, 'MIT')""")
def q_first_expansion(spark, sf_dir):
    rows = read_blocks(spark, sf_dir).select("doc", "ord", F.when(F.col("ord") % 3 == 2, F.concat(F.lit("A line\n"), "text")).otherwise(F.col("text")).alias("text"))
    return terms.expand_first(rows, {"MIT": "$1 \\ Institute"}).where(F.col("text").contains("MIT"))


RUNS = "runs as (select conv_id as doc, turn as ord, text, case when turn % 3 = 0 then 'a' else 'b' end as style from conversations)"


@query(f"with {RUNS}, n as (select *, case when lag(style) over (partition by doc order by ord) = style then 0 else 1 end as nw from runs), i as (select *, sum(nw) over (partition by doc order by ord) as isl from n) select doc, min(ord) as ord, min(style) as style, string_agg(text, '' order by ord) as text from i group by doc, isl")
def q_merge_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text", F.when(F.col("turn") % 3 == 0, "a").otherwise("b").alias("style"))
    return terms.merge_runs(rows)


@query(f"""with {BLOCKS_SQL}, {SPANS}, b as (select doc, count(*) as n_blocks, max(page) as n_pages, cast(sum(length(text)) as bigint) as chars from blocks group by 1),
o as (select doc, count(*) filter (x1 > 566 and x0 < 576) as n_overflow, count(*) filter (contains(text, '⟦')) as n_residue from spans group by 1) select b.*, n_overflow, n_residue from b join o on b.doc = o.doc""")
def q_doc_report(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return qa.document_report(rows, spans(rows))


_WIDTH = r"len(regexp_extract_all({t}, '[一-鿿]')) * 1.0 + len(regexp_extract_all({t}, '[iljtf.,:;''|! ]')) * 0.28 + len(regexp_extract_all({t}, '[mwMW@]')) * 0.85 + len(list_filter(regexp_extract_all({t}, '\p{{Lu}}'), lambda x: x not in ('M', 'W'))) * 0.68 + (length({t}) - len(regexp_extract_all({t}, '[一-鿿]')) - len(regexp_extract_all({t}, '[iljtf.,:;''|! ]')) - len(regexp_extract_all({t}, '[mwMW@]')) - len(list_filter(regexp_extract_all({t}, '\p{{Lu}}'), lambda x: x not in ('M', 'W')))) * 0.52"


@query(f"with {BLOCKS_SQL} select doc, ord, round(({_WIDTH.format(t='text')}) * size, 3) as w, case when x1 - x0 > 300 and ({_WIDTH.format(t='text')}) * size > (x1 - x0 - 2.4) * 1.03 then y1 + 9 else y1 end as y1 from blocks")
def q_text_width(spark, sf_dir):
    return read_blocks(spark, sf_dir).select("doc", "ord", F.round(layout.text_width_sql(F.col("text"), F.col("size")), 3).alias("w"), layout.grown_box(F.col("x0"), F.col("x1"), F.col("y1"), F.col("text"), F.col("size"), F.lit(1)).alias("y1"))


_UNITS = "list_sum(list_transform(string_split(t, ''), lambda c: case when regexp_matches(c, '[\\x{2E80}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FF60}]') then 100 when contains('iljtf.,:;''|! ', c) then 28 when contains('mwMW@', c) then 85 when regexp_matches(c, '\\p{Lu}') then 68 else 52 end))"
_MARKS = "regexp_extract(x[1], '^[，。、；：？！”’』」〉》】〕〕·…—–\\-．％‰℃°×]+')"


@query(f"""with {BLOCKS_SQL}, tk as (select doc, ord, size, 60.0 + ord % 3 * 90 as room, regexp_extract_all({STRIPPED.format(t="case when ord % 4 = 1 then replace(text, ' t', '。t') else text end")}, '(?s)[A-Za-z0-9@./%°§\\[\\]()\\-+–—'':;,_^<>«»×·≥≤=≈]+|.') as ts from blocks),
fold as (select doc, ord, list_reduce(list_prepend({{'l': cast([] as varchar[]), 'c': '', 'u': cast(0 as bigint), 'm': room * 100 / size}}, list_transform(ts, lambda t: {{'l': cast([] as varchar[]), 'c': t, 'u': cast({_UNITS} as bigint), 'm': room * 100 / size}})), lambda a, x:
 {{'l': case when trim(a.c) <> '' and a.u + x.u > a.m then list_append(a.l, rtrim(a.c)) else a.l end,
   'c': case when trim(a.c) <> '' and a.u + x.u > a.m then case when trim(x.c) = '' then '' else x.c end else a.c || x.c end,
   'u': case when trim(a.c) <> '' and a.u + x.u > a.m then case when trim(x.c) = '' then 0 else x.u end else a.u + x.u end, 'm': a.m}}) as f from tk),
li as (select doc, ord, list_append(f.l, rtrim(f.c)) as ls from fold),
mv as (select doc, ord, list_reduce(list_transform(ls, lambda t: [t]), lambda a, x: case when {_MARKS} <> '' and a[-1] <> '' then list_concat(a[1:len(a) - 1], [a[-1] || {_MARKS}, substr(x[1], length({_MARKS}) + 1)]) else list_append(a, x[1]) end) as ls from li)
select doc, ord, cast(len(ls) as int) as n_lines, array_to_string(ls, '|') as lines from mv""")
def q_wrap(spark, sf_dir):
    """Every block wrapped into a narrow or wide column, some with marks that may not begin a line."""
    text = F.when(F.col("ord") % 4 == 1, F.replace("text", F.lit(" t"), F.lit("。t"))).otherwise(F.col("text"))
    rows = read_blocks(spark, sf_dir).select("doc", "ord", text.alias("text"), "size", (F.col("ord") % 3 * 90 + 60.0).alias("room"))
    return layout.wrap_lines(rows, ["doc", "ord"]).select("doc", "ord", F.size("lines").alias("n_lines"), F.array_join("lines", "|").alias("lines"))


_STEPS = "greatest(0, cast(ceil((size - {floor}) / 0.25 - 1e-9) as int))"
_COUNT = """list_reduce(list_prepend({{'n': cast(1 as bigint), 'u': cast(0 as bigint), 'e': true, 'm': cast(floor(room * 100 / s) as bigint)}}, ts), lambda a, x:
 {{'n': a.n + case when not a.e and a.u + x.u > a.m then 1 else 0 end, 'u': case when not a.e and a.u + x.u > a.m then case when x.e then 0 else x.u end else a.u + x.u end,
   'e': case when not a.e and a.u + x.u > a.m then x.e else a.e and x.e end, 'm': a.m}}).n"""


def _ladder(name: str, floor: str, where: str) -> str:
    """Common table expressions: the lines of each text at each size from its own down to a floor."""
    return f"""{name}s as (select *, {floor} as low, unnest(range({_STEPS.format(floor=floor)} + 1)) as k from tk where {where}),
{name} as (select doc, ord, k, s, {_COUNT.format()} as n from (select *, case when k < {_STEPS.format(floor='low')} then size - 0.25 * k else least(size, low) end as s from {name}s))"""


@query(f"""with {BLOCKS_SQL}, tk as (select *, x1 - x0 as wide, x1 - x0 - 2.4 as room, list_transform(regexp_extract_all({STRIPPED.format(t='text')}, '(?s)[A-Za-z0-9@./%°§\\[\\]()\\-+–—'':;,_^<>«»×·≥≤=≈]+|.'), lambda t: {{'n': cast(0 as bigint), 'u': cast({_UNITS} as bigint), 'e': trim(t) = '', 'm': cast(0 as bigint)}}) as ts
 from (select doc, ord, text, x0, x1, size, length(text) as len, ord % 5 + 1 as nlines, 20.0 + ord % 7 * 30 as high, ord % 2 = 1 and ord % 5 >= 2 as prose from blocks)),
{_ladder('big', 'greatest(4.6, 0.55 * size)', 'true')}, {_ladder('one', 'case when wide > 300 then greatest(4.7, 0.78 * size) when wide < 60 then 4.2 else 4.7 end', 'nlines = 1 and len <= 60')},
own as (select doc, ord, case when nlines > 1 then high / nlines else size * 1.3 end as own from tk),
fits as (select big.*, tk.high, tk.nlines, tk.prose, greatest(s * 1.22, least(own, s * 1.45)) as h from big join tk using (doc, ord) join own using (doc, ord)),
best as (select doc, ord, coalesce(min(k) filter (n * h <= high + case when nlines = 1 and n = 1 then 2.0 else 0.0 end), max(k)) as k from fits group by 1, 2),
small as (select doc, ord, min(k) filter (n = 1) as k from one group by 1, 2 having max(n) filter (k = 0) > 1 and count(*) filter (n = 1) > 0),
got as (select f.doc, f.ord, f.n, f.s, f.h, f.high, f.nlines, f.prose from fits f join best using (doc, ord, k) where not exists (select 1 from small z where z.doc = f.doc and z.ord = f.ord)
 union all select o.doc, o.ord, o.n, o.s, greatest(o.s * 1.22, least(own, o.s * 1.45)), tk.high, tk.nlines, tk.prose from one o join small using (doc, ord, k) join own using (doc, ord) join tk using (doc, ord))
select doc, ord, cast(n as int) as n_lines, s as fs, round(case when nlines >= 3 and n > 1 and n < nlines and not prose then least(greatest(h, high / n), 2.2 * s) else h end, 6) as height from got""")
def q_fit(spark, sf_dir):
    """The size, lines and line height of every block in a box of its own width and some height."""
    o = F.col("ord")
    # lines that nearly fill the block or not: prose or a table's group
    ws = F.transform(F.sequence(F.lit(0), o % 5), lambda i: (F.col("x1") - F.col("x0")) * F.when(o % 2 == 1, 0.9).otherwise(0.5))
    rows = read_blocks(spark, sf_dir).select("doc", "ord", F.col("text").alias("zh"), "x0", F.lit(0.0).alias("y0"), "x1", (o % 7 * 30 + 20.0).alias("y1"), "size", (o % 5 + 1).alias("nlines"), ws.alias("line_ws"))
    return layout.fit_blocks(rows, ["doc", "ord"]).withColumn("height", F.round("height", 6))


@query(None)
def q_draw_ops(spark, sf_dir):
    """Every block laid out, some as contents lines; fitting and placing have no SQL, tests compare with fixtures."""
    rows = read_blocks(spark, sf_dir)
    k = F.col("ord") % 3
    zh = F.when(F.col("ord") % 16 == 5, F.concat(F.left("text", F.lit(30)), F.lit(" ⟦P"), F.col("page").cast("string"), F.lit("⟧"))).otherwise(F.col("text"))
    full = rows.select("doc", "page", "id", zh.alias("zh"), "x0", "y0", "x1", (F.col("y0") + 160).alias("y1"), "size", (F.col("ord") % 5 + 1).cast("int").alias("nlines"), "bold", F.lit(0xFF8000).alias("color"), F.when(k == 0, "l").when(k == 1, "c").otherwise("r").alias("align"),
                       F.transform(F.sequence(F.lit(0), F.col("ord") % 5), lambda i: F.col("y0") + i * 30.0).alias("line_ys"), F.when(F.col("ord") % 16 == 12, 90).alias("rot"), F.array("x0").alias("line_x0s"), F.array(F.col("x1") - F.col("x0")).alias("line_ws"), F.array(F.lit(25.0)).alias("line_hs"))
    return layout.draw_ops(layout.plan_lines(full))


@query("""select conv_id as doc, 1 as page, unnest([0, 1, 2]) as seq, unnest(['box', 'text', 'text']) as op, cast(unnest([55.0, 61.0, 61.0]) as double) as x, cast(unnest([630.0, 644.0, 658.0]) as double) as y, unnest(['557,772', 'Notice', 'Unofficial translation.']) as text, cast(unnest([0.0, 10.0, 8.0]) as double) as fs from (select distinct conv_id from conversations)""")
def q_notice_box(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc")).distinct()
    return layout.notice_box(docs, "Notice", "Unofficial translation.")


_PROTECTED = "`[^`\\n]+`|https?://[^\\s)>]+|\\{#[^}]*\\}"


@query(f"""with f as (select doc_id as doc, list_prepend('# T `x` [a](u)', list_filter(string_split(coalesce(text, '') || chr(10) || 'see https://e.x/' || doc_id || ' now', chr(10)), lambda x: trim(x) <> '')) as ls from documents),
l as (select doc, cast(unnest(range(len(ls))) as int) as ord, unnest(ls) as back from f)
select doc, ord, case when ord = 0 then '# T ⟦K0⟧ [a]⟦K1⟧' else array_to_string(list_transform(string_split_regex(back, '{_PROTECTED}'), lambda p, i: case when i = 1 then p else '⟦K' || (i - 2) || '⟧' || p end), '') end as text, back from l""")
def q_markdown_segments(spark, sf_dir):
    md = F.concat(F.lit("# T `x` [a](u)\n```\ncode https://no\n```\n"), F.coalesce("text", F.lit("")), F.lit("\nsee https://e.x/"), F.col("doc_id").cast("string"), F.lit(" now"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), md.alias("md"))
    rows = markdown.segments(docs, "doc", "md")
    return rows.select("doc", "ord", "text", markdown.unmasked(F.col("text"), F.col("kept")).alias("back"))


@query("with e as (select time_bucket(interval '10 minutes', ts) as start, event_type, value from events) select start, event_type, count(*) as n, round(sum(value), 2) as total from e group by 1, 2")
def q_windowed_counts(spark, sf_dir):
    """Beyond the documents: the streaming aggregate on a table."""
    return incremental.windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(f"with {BLOCKS_SQL}, t as (select doc, id, text || '!' as zh from blocks where ord % 3 = 0), n as (select doc, id, text || '?' as zh from blocks where ord % 5 = 0) select coalesce(t.doc, n.doc) as doc, coalesce(t.id, n.id) as id, coalesce(n.zh, t.zh) as zh from t full outer join n on t.doc = n.doc and t.id = n.id")
def q_top_up(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    base, new = rows.where("ord % 3 = 0").select("doc", "id", F.concat("text", F.lit("!")).alias("zh")), rows.where("ord % 5 = 0").select("doc", "id", F.concat("text", F.lit("?")).alias("zh"))
    return incremental.top_up(base, new)


@query(f"with {BLOCKS_SQL} select doc, page, ord, text as text_a, text || '!' as text_b from blocks where not (doc % 4 = 0 and page = 1)")
def q_zip_by_place(spark, sf_dir):
    rows = read_blocks(spark, sf_dir).select("doc", "page", "ord", "text")
    other = rows.where(~((F.col("doc") % 4 == 0) & (F.col("page") == 1) & (F.col("ord") == 0))).withColumn("text", F.concat("text", F.lit("!")))
    return columns.zipped_by_place(rows, other)


@query(f"with {BLOCKS_SQL} select doc, id, [y0 + 1.5, y1 - 2.0][1] as first_y, y0 - 2.0 as y0, y1 + 1.5 as y1 from blocks")
def q_line_shift(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    moved = overlay.shift_lines(F.array("y0", "y1"), F.array(F.lit(1.5), F.lit(-2.0), F.lit(9.0)), F.col("y0"), F.col("y1"))
    return rows.select("doc", "id", moved.alias("m")).select("doc", "id", F.element_at("m.ys", 1).alias("first_y"), "m.y0", "m.y1")


@query(f"with {BLOCKS_SQL} select doc, case when ord % 8 = 0 then id || '#' || k else id end as id, case when ord % 8 = 0 then split_part(text, ' ', k + 1) else text end as text from (select *, unnest(case when ord % 8 = 0 then range(least(2, len(string_split(text, ' ')))) else [0] end) as k from blocks)")
def q_line_splits(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    word = F.transform(F.split("text", " ", -1), lambda t, i: F.struct((F.col("y0") + i).alias("y"), F.col("x0").alias("x0"), F.lit(10.0).alias("w"), F.lit(9.0).alias("h"), t.alias("text")))
    rows = rows.withColumns({"lines": word, "color": F.lit(0)})
    split = rows.where("ord % 8 = 0").select("doc", "id", F.explode(F.array(F.lit(0), F.lit(1))).alias("line")).select("doc", "id", "line", F.concat("id", F.lit("#"), F.col("line").cast("string")).alias("new_id"), F.lit(None).cast("double").alias("size"), F.lit(None).cast("int").alias("color"), F.lit(None).cast("double").alias("dy"))
    return overlay.split_lines(rows, split).select("doc", "id", "text")


@query(f"with {BLOCKS_SQL} select doc, id from blocks where ord % 7 <> 3 and not starts_with({STRIPPED.format(t='text')}, 'Released')")
def q_drop_blocks(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return overlay.drop_blocks(rows, rows.where("ord % 7 = 3"), ("Released",)).select("doc", "id")


@query("select a.page_id as page, 'src' as doc_a, 'out' as doc_b from pages a join pages b on a.page_id = b.page_id")
def q_side_by_side(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"))
    return qa.side_by_side(p.withColumn("doc", F.lit("src")), p.withColumn("doc", F.lit("out")))
