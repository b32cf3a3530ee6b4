"""The thin contract queries over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_text, line_dedup, ngram_join, order_minhash, packing, passage_dedup, quality_rules, spelling, suffix_dedup, token_counts, url_filter

#: Fixed values of the url rules: verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, label``: urls whose path names a labelled document; 1 for a document of low quality or a toxic one."""
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]*/(\d{1,18})", 1)
    named = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull())
    marks = labels.groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("label"))
    return named.join(marks, "doc_id").select("url", "label")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = labelled_urls(pages, _table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, labelled, RULES).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    return decontaminate.decontaminate(documents, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(documents).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(documents, labels).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "p_low")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.histogram(_table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = collocations.counts(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return collocations.best(collocations.collocations(counted)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_passage_dedup": op6_passage_dedup,
    "op7_html_text": op7_html_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_spelling": op11_spelling,
    "op12_phrases": op12_phrases,
    "op13_fingerprints": op13_fingerprints,
}

_WORDS2 = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op2_decontaminate": f"""
with items as (select item_id, {_WORDS2.format(t="text")} w from benchmark),
docs as (select row_number() over () rid, doc_id, {_WORDS2.format(t="text")} w from documents),
windows as (
  select distinct item_id, len(w)::bigint m, array_to_string(w, ' ') p from items where len(w) between 1 and 9
  union select distinct item_id, 10, array_to_string(w[i:i + 9], ' ') from (select item_id, w, unnest(range(1, len(w) - 8)) i from items where len(w) >= 10)),
places as (
  select rid, i, m, array_to_string(w[i:i + m - 1], ' ') p
  from (select rid, w, m, unnest(range(1, len(w) - m + 2)) i from docs, (select distinct m from windows) where len(w) >= m)),
hits as (select rid, i, p.m, item_id from places p join windows using (p)),
words as (select rid, count(distinct k) n from (select rid, unnest(range(i, i + m)) k from (select distinct rid, i, m from hits)) group by rid),
found as (select rid, count(*) n, array_to_string(list(s order by s), ',') ids from (select distinct rid, item_id::varchar s from hits) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(words.n, 0)::bigint n_hit, coalesce(found.n, 0)::bigint n_items,
  sha256(coalesce(found.ids, '')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from docs left join words using (rid) left join found using (rid)
""",
    "op4_ngram_join": f"""
with recursive docs as (select row_number() over () rid, doc_id, {_WORDS4} w from documents),
sets as (
  select distinct rid, s from (
    select rid, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end s
    from (select rid, w, unnest(range(1, greatest(len(w) - 3, 2))) i from docs where len(w) > 0))),
sizes as (select rid, count(*) n from sets group by rid),
met as (select a.rid x, b.rid y, count(*) c from sets a join sets b on a.s = b.s and a.rid < b.rid group by a.rid, b.rid),
links as (
  select x, y from met join sizes p on p.rid = x join sizes q on q.rid = y where 100 * c >= 80 * (p.n + q.n - c)),
twoway as (select x, y from links union all select y, x from links),
reach as (select rid a, rid b from docs union select a, y from reach join twoway on x = b)
select d.doc_id, coalesce(any_value(sizes.n), 0)::bigint n_shingles, min(e.doc_id) component_id
from docs d left join sizes on sizes.rid = d.rid join reach on a = d.rid join docs e on e.rid = b group by d.rid, d.doc_id
""",
    "op5_line_dedup": r"""
with lines as (
  select rid, doc_id, unnest(l) line, generate_subscripts(l, 1) i
  from (select row_number() over () rid, doc_id, string_split(coalesce(text, ''), chr(10)) l from documents)),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
common as (select k from keyed where k <> '' group by k having count(distinct coalesce(doc_id, -1)) >= 10)
select doc_id, count(*)::bigint n_lines, count(common.k)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (common.k is null), '')) kept_sha256
from keyed left join common using (k) group by rid, doc_id
""",
    "op11_spelling": r"""
with recursive runs as (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w, count(*) k
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) r from documents) group by all),
steps as (
  select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
summed as (
  select w, k, xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || w, ''),
    lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) h
  from runs, steps where length(w) >= 5),
words as (
  select w, sum(k)::bigint n from (
    select case when h % 97 = 0 then substr(w, 1, (h % length(w))::bigint) || substr(w, (h % length(w))::bigint + 2) else w end w, k from summed)
  where length(w) >= 5 group by w having sum(k) >= 3),
cuts as (select w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) v from (select w, n, unnest(range(1, length(w) + 1)) i from words)),
pairs as (
  select distinct a.w x, b.w y, b.n from cuts a join cuts b on a.v = b.v and a.i = b.i and a.w <> b.w
  union select distinct a.w, b.w, b.n from cuts a join words b on a.v = b.w
  union select distinct b.w, a.w, a.n from cuts a join words b on a.v = b.w),
forms as (select x w, count(*) n_near, arg_min({'w': y, 'n': n}, {'n': -n, 'w': y}) f from pairs group by x),
found as (select words.w, words.n, coalesce(n_near, 0)::bigint n_near, case when f.n >= 2 * words.n then f end f from words left join forms using (w)),
chain as (select w, w last, 0 d from found union all select c.w, f.f.w, d + 1 from chain c join found f on f.w = c.last where f.f is not null)
select w word, f.w form, root, n, n_near, (f.n)::bigint form_n from found join (select w, arg_max(last, d) root from chain group by w) using (w)
""",
    "op12_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') lang, row_number() over () pid, regexp_extract_all(p, '[^\x20\x09]+') w
  from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents)),
total as (select lang, sum(len(w))::hugeint n from pieces group by lang),
f as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') phrase, count(*)::hugeint a
  from (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from pieces, (select unnest([1, 2, 3]) m) where len(w) >= m) group by all),
cand as (select lang, m, phrase, a, string_split(phrase, ' ') v from f where m >= 2 and a >= 10),
cuts as (
  select c.lang, c.phrase, c.m, c.a, k, x.a l, y.a r, (1000000 * c.a * c.a) // (x.a * y.a) score
  from (select *, unnest(range(1, m)) k from cand) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(v[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(v[k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (
  select distinct c.lang, c.phrase from cand c join cand d on d.lang = c.lang and d.m > c.m and 100 * d.a >= 50 * c.a
    and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
ranked as (
  select b.*, total.n, row_number() over (partition by b.lang order by score desc, a desc, phrase) rank
  from lowest b join total using (lang) anti join covered using (lang, phrase))
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked where rank <= 2000
""",
}
