"""Queries of the operators over their whole tables, and SQL that answers the same questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import bpe, decontaminate, filter_audit, license_scan, near_duplicates, quality, quality_rules, sharding, spelling, token_files, toxicity, url_filters, vector_search
from tidewater.llm.labelled import fold
from tidewater.llm.vocabulary import VOCABULARY
from tidewater.session import Scratch, table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def license_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source, then runs of 256 and of 16 doc_ids; the first of each run is its licence file."""
    run = F.col("doc_id") % 256
    name = F.when(F.col("doc_id") % 16 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    top = F.concat(F.col("source"), F.lit("/"), ((F.col("doc_id") - run) / 256).cast("long"))
    inner = F.concat(top, F.lit("/"), (F.floor(run / 16)).cast("long"))
    path = F.concat(F.when(run == 0, top).otherwise(inner), F.lit("/"), name)
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(license_files(spark, sf_dir), Scratch(spark, "op1"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.jaccard_classes(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))


def _held_out(scores: DataFrame, folds: int, held: int) -> DataFrame:
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))
    rest = [c for c in scores.columns if c not in ("doc_id", "score")]
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *rest)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return _held_out(toxicity.score(docs, model), 5, 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return _held_out(quality.score(docs, model), 3, 1)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, rule string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    out = f"{scratch.base}/files"
    token_files.write(table(spark, sf_dir, "documents"), VOCABULARY, out, scratch)
    return token_files.read(spark, out).drop("ids")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, Scratch(spark, "op10"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"), Scratch(spark, "op11"))[0]


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("lang"), Scratch(spark, "op12"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


OP2_SQL = r"""
with recursive w as (
  select row_number() over () rid, doc_id, list_filter(string_split_regex(lower(text), '[\t\n\x0B\f\r ]+'), lambda x: x <> '') ws from documents),
s as (select distinct rid, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) sh from w),
n as (select rid, count(*) c from s group by rid),
i as (select a.rid a, b.rid b, count(*) k from s a join s b on a.sh = b.sh and a.rid <> b.rid group by all),
l as (select i.a, i.b, k = x.c and k = y.c same from i join n x on x.rid = i.a join n y on y.rid = i.b where k >= 0.8 * (x.c + y.c - k) - 1e-9),
r(x, y) as (select rid, rid from w union select r.x, l.b from r join l on r.y = l.a),
c as (select r.x rid, min(w.doc_id) class_id from r join w on w.rid = r.y group by 1),
m as (select l.a rid, min(w.doc_id) filter (same) least, count(*) filter (same) copies, count(*) links from l join w on w.rid = l.b group by 1)
select w.doc_id, c.class_id, least(w.doc_id, m.least) copy_of, 1 + coalesce(m.copies, 0) n_copies, coalesce(m.links, 0) n_links
from w join c using (rid) left join m using (rid)
"""

#: Single lines and runs of lines against the templates, and inheritance. Runs without a word that fewer than a tenth of the files hold are left
#: out: they share too little weight with any template. Whole licence texts are not in it: no file of the tables is one; tests hold them.
OP1_SQL = r"""
with f as (select doc_id, text, source || '/' || (doc_id - doc_id % 256) // 256 || case when doc_id % 256 = 0 then '' else '/' || doc_id % 256 // 16 end dir,
  case when doc_id % 16 = 0 then 'LICENSE' else 'doc-' || doc_id || '.txt' end base from documents),
tpl(t, name, body, must) as (values @@TEMPLATES@@),
tw as (select t, name, must, unnest(list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '')) w from tpl),
dw as (select doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) w from documents),
n as (select count(*) n from documents),
df as (select w, count(*) df from dw group by 1),
idf as (select w, ln((1 + any_value(n.n)) / (1 + coalesce(any_value(df), 0))) + 1 idf, coalesce(any_value(df), 0) * 10 < any_value(n.n) rare from (select w from df union select w from tw) v left join df using (w), n group by w),
tv as (select t, name, must, w, count(*) * any_value(idf) y from tw join idf using (w) group by all),
tn as (select t, name, must, w, y / sqrt(sum(y * y) over (partition by t)) y from tv),
cand as (select distinct doc_id from dw join idf using (w) where rare and w in (select w from tw)),
ln as (select doc_id, u.i line, u.t from (select doc_id, string_split_regex(text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]') ls from documents semi join cand using (doc_id)) d, unnest(list_zip(range(len(ls)), ls)) x(u0), (select x.u0[1] i, x.u0[2] t) u),
lw as (select doc_id, row_number() over (partition by doc_id order by line) line, ws from (select doc_id, line, list_filter(string_split_regex(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') ws from ln) where len(ws) > 0),
lt as (select doc_id, line, w, count(*) tf from (select doc_id, line, unnest(ws) w from lw) group by all),
here as (select distinct doc_id, line from lt join idf using (w) where rare and w in (select w from tw)),
runs as (select distinct a.doc_id, a.line a, b.line b from lw a join here h on h.doc_id = a.doc_id and h.line between a.line and a.line + @@MOST@@ - 1 join lw b on b.doc_id = a.doc_id and b.line between h.line and a.line + @@MOST@@ - 1),
rw as (select doc_id, a, b, w, sum(tf) tf from runs join lt using (doc_id) where lt.line between a and b group by all),
rx as (select doc_id, a, b, w, tf * idf x from rw join idf using (w)),
nm as (select doc_id, a, b, sqrt(sum(x * x)) norm from rx group by all),
sc as (select doc_id, name, round(sum(x * y) / any_value(norm), 4) score from rx join tn using (w) join nm using (doc_id, a, b) group by doc_id, a, b, t, name, must
  having round(sum(x * y) / any_value(norm), 4) >= 0.7 and len(list_filter(must, lambda m: not list_contains(list(w), m))) = 0),
own as (select doc_id, arg_min(name, (-score, name)) own, max(score) score from sc group by 1),
pl as (select f.doc_id, dir, base, own.own, own.score from f left join own using (doc_id)),
gv as (select dir, arg_min(own, (-score, own)) given from pl where own is not null and base = 'LICENSE' group by 1),
nr as (select d.dir, arg_max(g.dir, length(g.dir)) from_dir, arg_max(g.given, length(g.dir)) given from (select distinct dir from pl) d join gv g on d.dir = g.dir or starts_with(d.dir, g.dir || '/') group by 1)
select doc_id, dir || '/' || base as path, own, score, coalesce(own, given) license, case when own is not null then 'header' when given is not null then 'inherited' else 'none' end how,
  case when own is null then from_dir end from_dir from pl left join nr using (dir)
"""
_SHOWN = license_scan.TEMPLATES + license_scan.tags(license_scan.NAMES)
OP1_SQL = OP1_SQL.replace("@@TEMPLATES@@", ", ".join(f"({i}, '{n}', '{t}', {list(m)}::varchar[])" for i, (n, t, m) in enumerate(_SHOWN)))
OP1_SQL = OP1_SQL.replace("@@MOST@@", str(max(len(license_scan._template_words(t)) for _, t, _ in _SHOWN)))

OP4_SQL = r"""
with dw as (select row_number() over () rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from (select distinct doc_id, text from documents)),
iw as (select row_number() over () iid, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark where item_id is not null),
ds as (select rid, i - 1 pos, array_to_string(w[i:i + 4], ' ') s from dw, unnest(range(1, len(w) - 3)) u(i)),
si as (select iid, array_to_string(w[i:i + 4], ' ') s from iw, unnest(range(1, len(w) - 3)) u(i)),
il as (select iid, count(*) len from si group by 1),
ic as (select iid, s, count(*) c from si group by all),
pairs as (select distinct rid, iid from ds join si using (s)),
hits as (select distinct rid, pos from ds where s in (select s from si)),
win as (select rid, iid, pos, len from pairs join hits using (rid) join il using (iid)),
wc as (select win.rid, win.iid, win.pos, win.len, ds.s, count(*) c from win join ds on ds.rid = win.rid and ds.pos between win.pos and win.pos + win.len - 1 group by all),
sim as (select rid, iid, pos, len, sum(least(wc.c, coalesce(ic.c, 0))) b, sum(wc.c) n from wc left join ic using (iid, s) group by rid, iid, pos, len),
ok as (select rid, item_id, pos, b / (n + len - b) v from sim join iw using (iid) where b / (n + len - b) >= 0.8 - 1e-9)
select any_value(doc_id) doc_id, item_id, arg_min(pos, (-v, pos)) as start, round(max(v), 6) similarity from ok join dw using (rid) group by rid, item_id
"""

OP6_SQL = """
with k as (select doc_id, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15)) as bigint) % @@SIZE@@ slot from documents)
select doc_id, slot, 'shard-' || lpad(cast([@@TABLE@@][slot + 1] as varchar), 3, '0') shard from k
""".replace("@@SIZE@@", str(sharding.TABLE)).replace("@@TABLE@@", ",".join(str(int(s[-3:])) for s in sharding.build_table(sharding.SHARDS)))

OP7_SQL = """
with u as (select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
r(verdict, rule, h, s) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m as (select page_id, host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict
  from p join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by all)
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') verdict from p left join m using (page_id)
"""

OP10_SQL = """
with v as (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.rid, q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and q.rid <> c.rid and len(q.e) = len(c.e)),
r as (select *, cast(row_number() over (partition by rid order by score desc, vec_id) as int) rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

#: The path of cutoffs as a case chain, the binomial tails as sums of terms.
OP11_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, '') stratum, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select rid, u.i, ws[u.i] || chr(10) || ws[u.i + 1] || chr(10) || ws[u.i + 2] g from w, unnest(range(1, len(ws) - 1)) u(i)),
again as (select rid, i from g join (select rid, g from g group by all having count(*) > 1) using (rid, g)),
rep as (select rid, count(distinct i + k) n from again, range(3) x(k) group by 1),
m as (select rid, doc_id, stratum, t, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
  len(ls) n_lines, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(n, 0) n_repeat_words from w left join rep using (rid)),
f as (select *, n_words < @@MIN@@ or n_repeat_words * 100 > n_words * @@MOST@@ base_failed, case when n_words < @@MIN@@ or n_repeat_words * 100 > n_words * @@MOST@@ then null @@PATH@@ end as level from m),
k as (select doc_id, min(quality) label from labels where doc_id is not null and quality in (0, 1) group by 1 having min(quality) = max(quality)),
tr as (select stratum, t, label, min(level) as level from f join k using (doc_id) where not base_failed group by all),
sizes as (select stratum, count(*) filter (label = 1) n, count(*) filter (label = 1) > 0 met from tr group by 1),
lv as (select stratum, j, any_value(n) n, count(*) filter (label = 1 and level <= j) good, count(*) filter (label = 0 and level <= j) bad from tr join sizes using (stratum), range(1, @@STEPS@@ + 1) x(j) group by all),
tail as (select *, case when good >= n then 1.0 else list_sum(list_transform(range(0, good + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(@@ALPHA@@) + (n - i) * ln(1 - @@ALPHA@@)))) end p from lv),
ok as (select *, bool_and(n > 0 and p <= @@DELTA@@ / (select greatest(count(*), 1) from sizes where met)) over (partition by stratum order by j) passed from tail),
cut as (select stratum, arg_max(j, (bad - good, -j)) cut from (select stratum, j, good, bad from ok where passed union all select stratum, 0, 0, 0 from sizes) group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(level > coalesce(cut, 0), true) kept, n_lines, stratum, level, coalesce(cut, 0) cut
from f left join cut using (stratum)
"""
_FIRES = {"symbols": "n_symbols * 1000 > word_chars * {}", "lines": "n_dup_lines * 100 > n_lines * {}", "words": "n_repeat_words * 100 > n_words * {}", "long": "word_chars * 10 > n_words * {}", "short": "word_chars * 10 < n_words * {}"}
for _name, _value in {
    "MIN": quality_rules.MIN_WORDS, "MOST": quality_rules.MAX_REPEATED, "STEPS": len(quality_rules.PATH), "ALPHA": quality_rules.ALPHA, "DELTA": quality_rules.DELTA,
    "PATH": " ".join(f"when {_FIRES[r].format(c)} then {j}" for j, (r, c) in enumerate(quality_rules.PATH, 1)),
}.items():
    OP11_SQL = OP11_SQL.replace(f"@@{_name}@@", str(_value))

OP12_SQL = r"""
with d as (select row_number() over () rid, doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
least_id as (select t, min(doc_id) least from d group by 1),
lab as (select doc_id, max(coalesce(quality = 1, false)) good, max(coalesce(toxic = 1, false)) toxic from labels where doc_id is not null group by 1),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic, (case when len(ws) < 100 then 1 else 0 end) + (case when len(list_distinct(ws)) * 100 < len(ws) * 80 then 2 else 0 end)
  + (case when length(regexp_replace(t, '[^A-Z]', '', 'g')) * 100 > length(t) * 10 then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
  + (case when coalesce(w.doc_id > least, false) then 16 else 0 end) fails from w join least_id using (t) left join lab on lab.doc_id = w.doc_id),
c as (select part, fails, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from f group by all),
l(x, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select p.x || q.x || r.x || s.x || t.x filter_order from l p, l q, l r, l s, l t where p.b + q.b + r.b + s.b + t.b = 31 and p.b | q.b | r.b | s.b | t.b = 31),
st as (select filter_order, step, (select sum(b) from l where strpos(filter_order, x) < step) earlier, (select b from l where strpos(filter_order, x) = step) own from o, range(1, 6) y(step)),
z as (select part, filter_order, step, own, coalesce(sum(n) filter (fails & own = 0 and fails & coalesce(earlier, 0) = 0), 0) kept, coalesce(sum(n) filter (fails & own <> 0 and fails & coalesce(earlier, 0) = 0), 0) removed,
  coalesce(sum(n) filter (fails & own <> 0 and fails & coalesce(earlier, 0) <> 0), 0) redundant, coalesce(sum(n) filter (fails = own), 0) unique_fails,
  coalesce(sum(good) filter (fails & own <> 0 and fails & coalesce(earlier, 0) = 0), 0) good_lost, coalesce(sum(toxic) filter (fails & own <> 0 and fails & coalesce(earlier, 0) = 0), 0) toxic_lost from c, st group by all)
select part, filter_order, step::int step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails, good_lost::bigint good_lost, toxic_lost::bigint toxic_lost,
  (sum(removed) over (partition by part, own))::bigint shapley from z
"""

#: The crc32 by its table, and all pairs of words of about equal length by edit distance; letters above ASCII stand as single bytes for it.
OP13_SQL = r"""
with recursive tab as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) tab from range(256) r(i)),
d as (select row_number() over () rid, coalesce(doc_id::varchar, '') id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+') rs from documents),
r as (select rid, id, r, count(*) c from (select rid, id, unnest(rs) r from d) where length(r) >= 6 group by all),
hx as (select *, hex(encode(id || ':' || r)) x from r),
h as (select r, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) h from hx, tab),
e as (select case when h % 199 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end word, c from h),
v as (select word, sum(c)::bigint n, translate(word, '@@FROM@@', '@@TO@@') x from e where length(word) >= 6 group by word having sum(c) >= 5),
p as (select a.word, b.word other, b.n other_n from v a join v b on a.word <> b.word and abs(length(a.x) - length(b.x)) <= 1 and levenshtein(a.x, b.x) = 1),
best as (select word, count(*) n_near, max(other_n) top, min_by(other, (-other_n, other)) other from p group by 1),
k as (select word, n, coalesce(n_near, 0) n_near, case when top >= 5 * n then other end form, case when top >= 5 * n then top end form_n from v left join best using (word)),
chain(word, far, depth) as (select word, word, 0 from k union all select chain.word, k.form, depth + 1 from chain join k on chain.far = k.word where k.form is not null),
ends as (select word, arg_max(far, depth) root from chain group by 1)
select word, form, root, n, n_near, form_n from k join ends using (word)
""".replace("@@FROM@@", spelling.ALPHABET[26:]).replace("@@TO@@", "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[:64])

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_ngram_jaccard_join, op3_toxicity, op5_quality_classifier, op4_benchmark_decontamination, op6_sharding,
        op7_url_filters, op8_token_files, op9_bpe, op10_exact_top_k, op11_quality_rules, op12_filter_audit, op13_spelling_variants, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_license_scan": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op4_benchmark_decontamination": OP4_SQL, "op6_sharding": OP6_SQL, "op7_url_filters": OP7_SQL, "op10_exact_top_k": OP10_SQL,
    "op11_quality_rules": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_spelling_variants": OP13_SQL,
}
