"""Queries over recurring texts, canonical resolution and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import canonical, chunking, recurring
from ..sources.lens import BLOCKS_SQL, read_blocks, table
from .q_text import BODY, HEADING, KEPT, NORM_KEY, NUMBERED, RUNNING_HEAD, STRIPPED, symbolic, toc

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


KEY = NORM_KEY.format(t="text")
#: Short lines of a whole source as one document: enough repeats for recurring groups.
SHELF_SQL = f"with {BLOCKS_SQL}, shelf as (select d.source as doc, d.doc_id as page, d.doc_id * 100000 + b.ord as ord, b.id, b.text, {KEY.replace('text', 'b.text')} as norm_key from blocks b join documents d on b.doc = d.doc_id where length(b.text) < 90)"


def shelf(spark, sf_dir):
    """Blocks seen with a source as their document; every operator on it aggregates before it shuffles."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("source"))
    rows = read_blocks(spark, sf_dir).where(F.length("text") < 90).join(docs, "doc")
    return rows.select(F.col("source").alias("doc"), F.col("doc").alias("page"), (F.col("doc") * 100_000 + F.col("ord")).alias("ord"), "id", "text")


REC = f"{SHELF_SQL}, rec as (select doc, norm_key, count(*) as n, count(distinct page) as pages from shelf group by doc, norm_key having count(*) >= 3)"


@query(f"{REC} select * from rec")
def q_recurring(spark, sf_dir):
    return recurring.recurring(shelf(spark, sf_dir))


# numbered variants of a few texts, so that groups hold varying numbers
EV = "ev as (select event_type as doc, user_id % 7 as page, event_id as ord, 'e' || event_id as id, 'User ' || user_id || ' of 50, ' || event_type || case when event_id % 50 = 0 and event_type = 'view' then ' 9' else '' end as text from events), evk as (select *, " + KEY + " as norm_key from ev)"


def numbered(spark, sf_dir):
    extra = F.when((F.col("event_id") % 50 == 0) & (F.col("event_type") == "view"), " 9").otherwise("")
    text = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" of 50, "), F.col("event_type"), extra)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("doc"), (F.col("user_id") % 7).alias("page"), F.col("event_id").alias("ord"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), text.alias("text"))


@query(f"with {EV}, g as (select doc, norm_key, min(len(regexp_extract_all(text, '[0-9]+'))) as least from evk group by 1, 2 having count(*) >= 3), v as (select e.doc, e.norm_key, unnest(regexp_extract_all(text, '[0-9]+')) as value, unnest(range(len(regexp_extract_all(text, '[0-9]+')))) as pos, least from evk e join g on e.doc = g.doc and e.norm_key = g.norm_key) select doc, norm_key, cast(pos as int) as pos from v where pos < least group by all having count(distinct value) > 1")
def q_varying_digits(spark, sf_dir):
    return recurring.varying_digits(numbered(spark, sf_dir))


TPL = f"""g as (select doc, norm_key, count(*) as n, min(ord) as seen from evk group by 1, 2 having count(*) >= 3 and min(len(regexp_extract_all(text, '[0-9]+'))) = max(len(regexp_extract_all(text, '[0-9]+')))),
m as (select doc, norm_key, text from (select doc, norm_key, text, count(*) as c, min(ord) as f from evk group by all) qualify row_number() over (partition by doc, norm_key order by c desc, f) = 1),
tpl as (select g.doc, g.norm_key, m.text, {NUMBERED.format(t='m.text')} as template, g.n, g.seen from g join m on g.doc = m.doc and g.norm_key = m.norm_key)"""
TPL2 = TPL.replace("evk", "shelf")


@query(f"with {EV}, {TPL} select doc, norm_key, text, template, regexp_replace(template, '⟦N[0-9]+⟧', '#', 'g') as sig, n, seen from tpl")
def q_recurring_templates(spark, sf_dir):
    return recurring.templates(numbered(spark, sf_dir))


@query("with c as (select source, lang, count(*) as n, min(doc_id) as f from documents group by 1, 2) select source, lang, n from c qualify row_number() over (partition by source order by n desc, f) = 1")
def q_mode_first_seen(spark, sf_dir):
    return recurring.first_seen_mode(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")


@query(f"with {BLOCKS_SQL} select doc, count(*) filter (bold) * 2 > count(*) as bold from blocks group by doc")
def q_majority(spark, sf_dir):
    return recurring.majority(read_blocks(spark, sf_dir), ["doc"], "bold")


def _wordrep(t: str, words: dict[str, str]) -> str:
    for w, z in words.items():
        t = rf"regexp_replace({t}, '\b{w}\b', '{z}', 'g')"
    return t


_SAME = f"(regexp_matches(sig, '^(De|La) ') or sig = 'Les.' or not regexp_matches(sig, '[A-Za-z]{{2,}}') or {symbolic('text')})"
RESOLVED = f"""{SHELF_SQL}, {TPL2}, s as (select *, regexp_replace(template, '⟦N[0-9]+⟧', '#', 'g') as sig from tpl),
res as (select doc, norm_key, n, seen, sig, text,
 case when norm_key = 'Nicht.' then null when sig = '#' then '⟦N0⟧' when sig = 'The.' then 'Der.' when regexp_matches(sig, '^Released under') then {_wordrep('template', {'Released': 'Veröffentlicht', 'under': 'unter'})}
 when regexp_matches(sig, '^[A-Z]{{2,}}') then template when regexp_matches(sig, '^(Th|On|An)') then {_wordrep('template', {'the': 'der', 'of': 'von'})} when {_SAME} then template end as zh,
 case when norm_key = 'Nicht.' then 'skip' when sig in ('#', 'The.') then 'signature' when regexp_matches(sig, '^Released under') then 'pattern0' when regexp_matches(sig, '^[A-Z]{{2,}}') then 'pattern1' when regexp_matches(sig, '^(Th|On|An)') then 'pattern2' when {_SAME} then 'identity' else 'missing' end as rule from s)"""


def _resolved(spark, sf_dir):
    return canonical.resolve(recurring.templates(shelf(spark, sf_dir)))


@query(f"{RESOLVED} select * from res")
def q_canonical_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query(f"{RESOLVED} select doc, sig, left(text, 70) as sample from res where rule = 'missing' qualify row_number() over (partition by sig order by doc, seen) = 1")
def q_missing_sigs(spark, sf_dir):
    return canonical.missing_signatures(_resolved(spark, sf_dir))


@query(f"with {EV}, {TPL} select e.doc, e.id, e.text as zh from evk e join tpl t on e.doc = t.doc and e.norm_key = t.norm_key")
def q_apply_recurring(spark, sf_dir):
    rows = numbered(spark, sf_dir)
    return recurring.apply_recurring(rows, recurring.templates(rows))


@query(f"{RESOLVED} select doc, page, s.id, norm_key from shelf s where not exists (select 1 from res r where r.doc = s.doc and r.norm_key = s.norm_key and r.zh is not null) and not (page % 10 = 0 and s.id = 'p1b0')")
def q_slim_chunks(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    items = recurring.candidates(rows).select("doc", F.concat_ws("/", "page", "id").alias("id"), "norm_key", "page", F.col("id").alias("block"))
    covered = items.where("page % 10 = 0 and block = 'p1b0'").select("doc", "id")
    left = recurring.slim(items, covered, _resolved(spark, sf_dir).where("zh is not null"))
    return left.select("doc", "page", F.col("block").alias("id"), "norm_key")


ITEM = f"not {KEPT.format(t='text')} and not {symbolic('text')}"
PAGES = f"pages_ as (select doc, page, cast(sum(case when {ITEM} then length({toc('text')}) else 0 end) as bigint) as chars from blocks group by 1, 2)"
HEAD = f"(bold or size >= 11) and regexp_matches({STRIPPED.format(t='text')}, '{HEADING}')"
CONT = "cont as (select doc, page from blocks where page % 6 = 0 and page > 1 group by 1, 2)"
SAFE = f"""edge as (select doc, page, min_by({{'t': text, 'b': bold, 's': size}}, case when {BODY} then ord end) as f, max_by({{'t': text, 'w': x1 - x0}}, case when {BODY} then ord end) as l, min(ord) as o from blocks group by 1, 2),
lagged as (select *, lag(l) over (partition by doc order by page) as p, row_number() over (partition by doc order by page) as nth from edge),
safe as (select g.doc, g.page, case when c.page is not null then 'table goes on' when coalesce(not regexp_matches({STRIPPED.format(t='p.t')}, '[.!?:;”’)°]$') and not ((f.b or f.s >= 11) and regexp_matches({STRIPPED.format(t='f.t')}, '{HEADING}')) and not (f.b and f.s >= 11) and p.w > 260, false) then 'paragraph goes on' else '' end as reason
 from lagged g left join cont c on g.doc = c.doc and g.page = c.page where nth > 1)"""


@query(f"with {BLOCKS_SQL}, {PAGES} select * from pages_")
def q_page_chars(spark, sf_dir):
    return chunking.page_chars(read_blocks(spark, sf_dir))


GOES_ON = "page % 6 = 0 and page > 1"


def continued(rows):
    return rows.where(GOES_ON).select("doc", "page").distinct()


@query(f"with {BLOCKS_SQL}, {CONT}, {SAFE} select doc, page, reason = '' as safe, reason from safe")
def q_safe_boundary(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return chunking.safe_boundary(rows, continued(rows))


_TAB = "tab as (select doc, page, ord as table_no, 50.0 + doc % 2 as x0, 550.0 as x1, case when ord % 3 = 1 then 600.0 else 700.0 end as y1, length(text) % 2 + 3 as cols from blocks)"


@query(f"""with {BLOCKS_SQL}, {_TAB}, f as (select doc, page, min_by({{'a': round(x0), 'b': round(x1), 'c': cols}}, table_no) as f, max_by({{'a': round(x0), 'b': round(x1), 'c': cols}}, table_no) as l, max_by(y1, table_no) as y from tab group by 1, 2),
g as (select *, lag(page) over w as lp, lag(l) over w as ll, lag(y) over w as ly from f window w as (partition by doc order by page)) select doc, page from g where lp = page - 1 and ly > 655 and ll = f""")
def q_table_continuation(spark, sf_dir):
    o = F.col("ord")
    tables = read_blocks(spark, sf_dir).select("doc", "page", o.alias("table_no"), (F.col("doc") % 2 + 50.0).alias("x0"), F.lit(550.0).alias("x1"), F.when(o % 3 == 1, 600.0).otherwise(700.0).alias("y1"), (F.length("text") % 2 + 3).alias("cols"))
    return chunking.table_continuation(tables)


FOLD = f"""{PAGES}, {CONT}, {SAFE},
seq as (select g.doc, g.page, g.chars, coalesce(s.reason = '', true) as ok, row_number() over (partition by g.doc order by g.page) as i from pages_ g left join safe s on g.doc = s.doc and g.page = s.page),
fold as (select doc, page, i, 1 as chunk, chars as c, false as forced from seq where i = 1
 union all select s.doc, s.page, s.i,
  case when f.forced or (f.c >= 14000 and s.ok) then f.chunk + 1 else f.chunk end,
  case when f.forced or (f.c >= 14000 and s.ok) then s.chars else f.c + s.chars end,
  (f.forced or not (f.c >= 14000 and s.ok)) and (case when f.forced then s.chars else f.c + s.chars end) >= 21000
 from fold f join seq s on s.doc = f.doc and s.i = f.i + 1),
chunk_ as (select doc, page, cast(chunk as bigint) as chunk, forced from fold)"""
CHUNKED = f"with recursive {BLOCKS_SQL}, {FOLD}"


def _chunks(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return rows, chunking.chunks_of(chunking.pages(rows), F.expr(GOES_ON))


@query(f"{CHUNKED} select * from chunk_")
def q_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir)[1]


ITEMS = f"item as (select b.doc, c.chunk, b.page, b.ord, b.id, {toc('b.text')} as text from blocks b join chunk_ c on b.doc = c.doc and b.page = c.page where {ITEM.replace('text', 'b.text')})"


@query(f"{CHUNKED}, {ITEMS} select doc, chunk, page, ord, id, text from item")
def q_chunk_items(spark, sf_dir):
    rows, chunks = _chunks(spark, sf_dir)
    return chunking.chunk_items(chunking.items(rows), chunks)


@query(f"""{CHUNKED}, {ITEMS}, pg as (select doc, chunk, min(page) as first_page, max(page) as last_page from chunk_ group by 1, 2),
o as (select *, row_number() over (partition by doc, chunk order by ord) as h, row_number() over (partition by doc, chunk order by ord desc) as t from item),
e as (select doc, chunk, string_agg(text, ' ⏎ ' order by ord) filter (h <= 1) as lead_, string_agg(text, ' ⏎ ' order by ord) filter (t <= 2) as trail from o group by 1, 2),
j as (select pg.*, lag(trail) over w as b, lead(lead_) over w as a from pg left join e on pg.doc = e.doc and pg.chunk = e.chunk window w as (partition by pg.doc order by pg.chunk))
select doc, chunk, first_page, last_page, right(coalesce(b, ''), 900) as context_before, left(coalesce(a, ''), 400) as context_after from j""")
def q_chunk_context(spark, sf_dir):
    rows, chunks = _chunks(spark, sf_dir)
    return chunking.contexts(chunking.chunk_items(chunking.items(rows), chunks), chunks)


# the data has no heading of the default pattern: a bold short line stands in
_CAPS = r"^[A-ZÄÖÜÉÈ][a-zäöüéèêçñ]+\.$"
HEADS = f"hd as (select doc, page, ord, replace(left(text, 60), chr(10), ' ') as title from blocks where (bold or size >= 11) and regexp_matches({STRIPPED.format(t='text')}, '{_CAPS}'))"


def _heads(rows):
    from dataclasses import replace

    from ..config import DEFAULT

    return chunking.headings(rows, replace(DEFAULT, heading_pattern=_CAPS))


@query(f"""{CHUNKED}, {HEADS}, fp as (select doc, chunk, min(page) as page from chunk_ group by 1, 2)
select fp.doc, fp.chunk, coalesce((select max_by(title, ord) from hd where hd.doc = fp.doc and hd.page < fp.page), '文档起始') as title from fp""")
def q_heading_asof(spark, sf_dir):
    rows, chunks = _chunks(spark, sf_dir)
    return chunking.titles(chunks, _heads(rows))


@query(f"with {BLOCKS_SQL}, {HEADS}, z as (select doc, max(page) as z from blocks group by 1), n as (select *, lead(page) over (partition by doc order by page, ord) as nx from hd) select n.doc, ord, title, page as first_page, greatest(page, coalesce(nx - 1, z)) as last_page from n join z on n.doc = z.doc")
def q_outline(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return chunking.outline(_heads(rows), rows.select("doc", "page"))


# the level of a heading by the length of its title
_TREE = f"""{HEADS}, lv as (select *, 1 + length(title) % 4 as level from hd), z as (select doc, max(page) as z from blocks group by 1),
tree as (select h.doc, h.ord, title, cast(level as int) as level, (select max(p.ord) from lv p where p.doc = h.doc and p.ord < h.ord and p.level < h.level) as parent, page as first_page,
 greatest(page, coalesce((select min(n.page) from lv n where n.doc = h.doc and n.ord > h.ord and n.level <= h.level) - 1, z)) as last_page from lv h join z on z.doc = h.doc)"""


def _tree(spark, sf_dir):
    rows = read_blocks(spark, sf_dir)
    return rows, chunking.outline_tree(_heads(rows).withColumn("level", F.length("title") % 4 + 1), rows.select("doc", "page"))


@query(f"with {BLOCKS_SQL}, {_TREE} select * from tree")
def q_outline_tree(spark, sf_dir):
    return _tree(spark, sf_dir)[1]


@query(f"with {BLOCKS_SQL}, {_TREE} select t.doc, t.ord, level, parent, case when t.ord % 3 = 0 then 'Ü ' || left(b.text, 20) else title end as title, first_page as page from tree t join blocks b on b.doc = t.doc and b.ord = t.ord")
def q_bookmarks(spark, sf_dir):
    rows, tree = _tree(spark, sf_dir)
    zh = rows.where("ord % 3 = 0").select("doc", "ord", F.concat(F.lit("Ü "), F.left("text", F.lit(20))).alias("zh"))
    # a translation that is blank is none
    blank = rows.where("ord % 3 = 1").select("doc", "ord", F.lit(" \n").alias("zh"))
    return chunking.bookmarks(tree, zh.unionByName(blank))


_AB = ("THE", "CI", "MIT", "ED", "SE")


@query(f"{CHUNKED}, {ITEMS}, a as (select doc, chunk, unnest([{', '.join(repr(a) for a in _AB)}]) as ab, text from item), f as (select doc, ab, min(chunk) as chunk from a where regexp_matches(text, '(^|[^\\pL0-9_])' || ab || '([^\\pL0-9_]|$)') group by 1, 2) select doc, chunk, string_agg(ab, ',' order by ab) as abbrevs from f group by 1, 2")
def q_first_abbrev(spark, sf_dir):
    from dataclasses import replace

    from ..config import DEFAULT

    rows, chunks = _chunks(spark, sf_dir)
    return chunking.first_abbreviations(chunking.chunk_items(chunking.items(rows), chunks), replace(DEFAULT, abbreviations=_AB))


@query(f"""{CHUNKED}, {ITEMS}, a as (select doc, count(distinct chunk) as n_chunks, count(*) filter (forced) as n_forced from chunk_ group by 1), b as (select doc, cast(sum(chars) as bigint) as s from pages_ group by 1), c as (select doc, count(*) as n_items from item group by 1)
select a.doc, n_chunks, n_forced, coalesce(n_items, 0) as n_items, s // n_chunks as mean_chars from a join b on a.doc = b.doc left join c on a.doc = c.doc""")
def q_chunk_summary(spark, sf_dir):
    rows, chunks = _chunks(spark, sf_dir)
    return chunking.chunk_summary(chunks, chunking.page_chars(rows), chunking.items(rows))
