"""Queries on the texts of ``documents`` and the spellings of ``terms``, with their SQL counterparts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from recallgrid.functions import hangul, perturb, text
from recallgrid.operators.fusion import top_k
from recallgrid.operators.hygiene import contradictions, overlapping
from recallgrid.operators.joins import related_to_all, related_to_any, relatedness
from recallgrid.operators.lexical import bm25, corpus_stats, postings, query_terms
from recallgrid.session import cut_lineage, read_table
from recallgrid.sources.notes import parse_notes
from recallgrid.sources.store import unchanged

QUERY_TEXTS = {
    "q1": "세금 비용은 얼마였나",
    "q2": "the backup failed after the deploy",
    "q3": "보일러 수리 일정",
    "q4": "who moved the backlog without asking",
    "q5": "마이그레이션 설정에서 값을 올렸다",
    "q6": "error timeout skipped",
    "q7": "면담 자리에서 들은 서버 이야기",
    "q8": "subscription refund budget",
    "q9": "여권 비자 환율",
    "q10": "nothing zzqqyyxx",
}
LEAST_CONFLICT = 0.15
ENTITIES = ["서버", "비용", "보일러"]


def _texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")


def _bodies(spark, sf_dir):
    """Documents as notes with a title from their front matter."""
    notes = parse_notes(_texts(spark, sf_dir).withColumn("name", F.lit("")), "text", "doc_id")
    raw = _texts(spark, sf_dir).withColumnRenamed("doc_id", "node_id").withColumnRenamed("text", "raw")
    titled = F.regexp_extract(F.col("raw"), r"(?s)^---\n.*?\n---\n", 0).rlike(r"(?m)^title:")
    joined = notes.join(raw, "node_id").withColumn("title", F.when(titled, F.col("title")).otherwise(""))
    return joined.select("node_id", "title", F.when(F.col("title") != "", F.concat_ws("\n", "title", "raw")).otherwise(F.col("raw")).alias("body"))


def _plain(spark, sf_dir):
    return _texts(spark, sf_dir).select(F.col("doc_id").alias("node_id"), F.col("text").alias("body"), F.lit("").alias("title"))


def _queries(spark):
    return spark.createDataFrame(list(QUERY_TEXTS.items()), "qid string, text string")


def tok_words(spark, sf_dir):
    words = _texts(spark, sf_dir).withColumn("w", text.words_column(F.col("text")))
    return words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.sha1(F.array_join("w", " ")).alias("digest"))


def tok_filters(spark, sf_dir):
    """Words that carry no signal, per kind of reason."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(text.WORD_CLASS), F.lit(0))
    w = _texts(spark, sf_dir).select(F.explode(found).alias("w"))
    stop, number = F.col("w").isin(text.STOPWORDS), (F.length("w") > text.LONG_NUMBER) & F.col("w").rlike(r"^\p{Nd}+$")
    return w.groupBy(F.when(stop, "stopword").when(number, "long number").otherwise("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def tok_char_ngrams(spark, sf_dir):
    words = _texts(spark, sf_dir).select(F.explode(text.words_column(F.col("text"))).alias("w"))
    grams = F.when(F.col("w").rlike("[가-힣]"), text.grams_column(F.col("w"), 2)).when(F.length("w") > 3, text.grams_column(F.col("w"), 3))
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(grams).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))


def tok_lexical_counts(spark, sf_dir):
    terms = postings(_plain(spark, sf_dir), title_boost=1.0)
    return terms.groupBy("term").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_docs"))


def ko_cross_space(spark, sf_dir):
    return tok_lexical_counts(spark, sf_dir).filter(F.col("term").startswith(text.CROSS_MARK))


def doc_len(spark, sf_dir):
    rows = postings(_plain(spark, sf_dir), title_boost=1.0)
    return rows.groupBy(F.col("node_id").alias("doc_id")).agg(F.max("doc_len").alias("doc_len"))


def tf_sublinear(spark, sf_dir):
    rows = postings(_plain(spark, sf_dir), title_boost=1.0)
    return rows.select(F.col("node_id").alias("doc_id"), "term", F.round("tf", 6).alias("tf"))


def title_boost_tf(spark, sf_dir):
    """Weights of the terms of titled notes."""
    bodies = _bodies(spark, sf_dir).filter("title <> ''")
    return postings(bodies).groupBy(F.col("node_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("tf"), 5).alias("tf_sum"))


def df_idf(spark, sf_dir):
    n, _ = corpus_stats(read_table(spark, sf_dir, "documents").filter("text is not null").select(F.lit(1).alias("doc_len")))
    df = tok_lexical_counts(spark, sf_dir).select("term", F.col("n_docs").alias("df"))
    return df.withColumn("idf", F.round(F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))


def _scored(spark, sf_dir, queries):
    terms = cut_lineage(query_terms(queries))
    asked = {r["term"] for r in terms.select("term").distinct().collect()}  # the fixed query texts' terms
    rows = cut_lineage(postings(_plain(spark, sf_dir), title_boost=1.0, only=asked))
    lengths = rows.filter("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("mean")).first()
    return bm25(terms, rows.filter("term is not null"), max(1, lengths["n"]), max(1.0, lengths["mean"] or 0.0))


def bm25_scores(spark, sf_dir):
    return _scored(spark, sf_dir, _queries(spark)).select("qid", F.col("node_id").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    best = top_k(_scored(spark, sf_dir, _queries(spark)), 24)
    return best.select("qid", F.col("node_id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


def _relations(spark, sf_dir):
    entities = spark.createDataFrame([(e, e) for e in ENTITIES], "qid string, text string")
    return relatedness(_scored(spark, sf_dir, entities).withColumnRenamed("qid", "entity"))


def join_and(spark, sf_dir):
    return related_to_all(_relations(spark, sf_dir), len(ENTITIES)).select(F.col("node_id").alias("doc_id"), F.round("score", 6).alias("score"))


def join_or(spark, sf_dir):
    return related_to_any(_relations(spark, sf_dir), len(ENTITIES)).select(F.col("node_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _word_sets(spark, sf_dir):
    words = F.array_distinct(F.filter(text.words_column(F.col("text")), lambda w: F.length(w) > 1))
    return _texts(spark, sf_dir).select("doc_id", words.alias("words"), text.has_negation(F.col("text")).alias("negated"))


def contradiction_pairs(spark, sf_dir):
    """Conflicts of the documents whose id is divisible by 100 (the stated query set) with all others."""
    sets = _word_sets(spark, sf_dir)
    asked = cut_lineage(sets.filter(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "node_id"))
    # A score is at most 1.5 times the jaccard, as the cosine isn't negative here.
    pairs = overlapping(asked, sets.withColumnRenamed("doc_id", "other_id"), LEAST_CONFLICT / 1.5, best=(5, LEAST_CONFLICT))
    cosine = F.col("shared") / F.sqrt(F.col("n").cast("double") * F.col("m"))
    return contradictions(pairs.withColumn("cosine", cosine), min_score=LEAST_CONFLICT)


def negation_flags(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", text.has_negation(F.col("text")).alias("negated"))


def content_sha(spark, sf_dir):
    rows = read_table(spark, sf_dir, "documents").filter("text is not null")
    empty = F.array().cast("array<string>")
    tags = F.filter(F.array("source", "lang"), lambda x: x.isNotNull())
    digest = text.content_digest(F.col("text"), F.coalesce("kind", F.lit("note")), tags, empty, F.lit(1.0), F.lit(False), "256:65536", F.lit(""))
    return rows.select("doc_id", digest.alias("content_sha"))


def reindex_unchanged(spark, sf_dir):
    """Documents whose trimmed text has the digest of the text as stored, so need no new index entry."""
    rows = _texts(spark, sf_dir).withColumnRenamed("doc_id", "node_id")
    stored = rows.select("node_id", F.sha1("text").alias("content_sha"))
    return unchanged(rows.select("node_id", F.sha1(F.trim("text")).alias("content_sha")), stored).select(F.col("node_id").alias("doc_id"))


def note_parse(spark, sf_dir):
    notes = parse_notes(_texts(spark, sf_dir).withColumn("name", F.lit("untitled")), "text", "doc_id")
    title = F.when(F.col("title") == F.col("node_id").cast("string"), "").otherwise(F.col("title"))
    return notes.select(F.col("node_id").alias("doc_id"), title.alias("title"), F.array_join("tags", ",").alias("tags"), F.array_join("links", ",").alias("links"), F.sha1("text").alias("body_sha"))


def ko_jamo(spark, sf_dir):
    t = read_table(spark, sf_dir, "terms")
    return t.select("tid", hangul.jamo_column(F.col("term")).alias("jamo"), hangul.jamo_column(F.col("term"), pad=True).alias("padded"))


def ko_strip_suffix(spark, sf_dir):
    words = _texts(spark, sf_dir).select(F.explode(text.words_column(F.col("text"))).alias("word")).distinct()
    return words.select("word", hangul.strip_suffix_column(F.col("word")).alias("stem"))


def fnv_bucket(spark, sf_dir):
    @F.pandas_udf("b1 long, b2 long")
    def buckets(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text.bucket_pair(w, 65_536) for w in words], columns=["b1", "b2"])

    t = read_table(spark, sf_dir, "terms").filter("term is not null")
    return t.select("tid", buckets("term").alias("b")).select("tid", "b.b1", "b.b2")


def query_perturbations(spark, sf_dir):
    """Deterministic mutations of each document, as a query."""
    q = _texts(spark, sf_dir).select("doc_id", F.col("text").alias("q"))
    c = F.col("q")
    return q.select("doc_id", perturb.unspaced(c).alias("spacing"), perturb.longest_word(c).alias("compound"), perturb.translated(c).alias("koen"), perturb.head_only(c).alias("homonym"))


def query_typos(spark, sf_dir):
    """Mutations that draw: a particle exchanged, and letters mistyped, in each document as a query."""
    q = _texts(spark, sf_dir).select("doc_id", F.col("text").alias("q"))
    return q.select("doc_id", perturb.swapped_particle(F.col("q")).alias("josa"), perturb.mistyped(F.col("q")).alias("jamo"))


def stored_text(spark, sf_dir):
    """What the store keeps of a body."""
    return _texts(spark, sf_dir).select("doc_id", F.sha1("text").alias("kept_sha"))


_NAMES = """tok_words tok_filters tok_char_ngrams tok_lexical_counts ko_cross_space doc_len tf_sublinear title_boost_tf df_idf bm25_scores bm25_topk
join_and join_or contradiction_pairs negation_flags content_sha reindex_unchanged note_parse ko_jamo ko_strip_suffix fnv_bucket query_perturbations
query_typos stored_text""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

# ── SQL ──────────────────────────────────────────────────────────────────────────────────────────────


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOP = _quoted(text.STOPWORDS)
_CLASS = r"[\p{L}\p{N}_'']+"
_TEXTS = "docs as (select doc_id, text from documents where text is not null)"


def _words_of(c: str) -> str:
    return f"""list_transform(list_filter(regexp_extract_all(lower({c}), '{_CLASS}'),
    lambda w: w not in ({_STOP}) and not (length(w) > 6 and regexp_full_match(w, '\\p{{Nd}}+'))), lambda w: substr(w, 1, 128))"""


def _strip_of(w: str) -> str:
    longs = " ".join(f"when regexp_matches({w}, '^(.{{2,}}?)(?:{'|'.join(s)})$') then regexp_extract({w}, '^(.{{2,}}?)(?:{'|'.join(s)})$', 1)" for s in hangul.LONG_SUFFIXES)
    last, before = f"substr({w}, length({w}), 1)", f"substr({w}, length({w}) - 1, 1)"
    tail = f"((unicode({before}) - 44032) % 28)"
    return f"""case when length({w}) < 3 or not regexp_matches({last}, '[가-힣]') then {w} {longs}
    when regexp_matches({before}, '[가-힣]') and ({last} in ({_quoted(hangul.AFTER_ANY)}) or ({last} in ({_quoted(hangul.AFTER_CONSONANT)}) and {tail} > 0)
      or ({last} in ({_quoted(hangul.AFTER_VOWEL)}) and {tail} = 0) or ({last} = '로' and {tail} = 8)) then substr({w}, 1, length({w}) - 1) else {w} end"""


def _grams(w: str, n: int) -> str:
    return f"case when length({w}) > {n} then list_transform(range(1, length({w}) - {n} + 2), lambda i: substr({w}, i::bigint, {n})) else [] end"


def tokens_sql(source: str) -> str:
    """CTE bodies that end in ``toks(id, term)``: the tokens of ``source(id, body)``."""
    return f"""
split as (select id, {_words_of("body")} as ws from {source}),
placed as (select id, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
marked as (select *, regexp_matches(w, '[가-힣]') as ko from placed),
runs as (select *, i - row_number() over (partition by id, ko order by i) as run from marked),
spans as (select *, max(i) over (partition by id, ko, run) as run_end, lead(w) over (partition by id, ko, run order by i) as next_w from runs),
stems as (select *, case when ko then {_strip_of("w")} else w end as stem from spans),
parts as (
  select id, i as k1, 0 as k2, 0::bigint as k3, [w] as ts from stems
  union all select id, i, 0, 1, [stem] from stems where ko and stem <> w
  union all select id, i, 2, 0, {_grams("w", 2)} from stems where ko
  union all select id, i, 2, 0, {_grams("w", 3)} from stems where not ko and length(w) > 3
  union all select id, run_end + 1, 1, i, ['{text.CROSS_MARK}' || substr(w, length(w), 1) || substr(next_w, 1, 1)] from stems where ko and next_w is not null
),
toks as (select id, unnest(ts) as term from parts)"""


_COUNTS = f"with {_TEXTS}, src as (select doc_id as id, text as body from docs), {tokens_sql('src')}, tc as (select id, term, count(*) as n from toks group by id, term)"
_LENS = "lens as (select id, count(*) as doc_len from toks group by id)"


def _renamed(sql: str, prefix: str) -> str:
    """Token CTEs under other names, for a second token stream in one statement."""
    return re.sub(r"\b(split|placed|marked|runs|spans|stems|parts|toks)\b", rf"{prefix}\1", sql)


def _bm25_sql(queries: dict[str, str]) -> str:
    rows = ", ".join(f"({_quoted([k, v])})" for k, v in queries.items())
    mine = _renamed(tokens_sql("qsrc"), "q")
    return f"""{_COUNTS}, {_LENS}, qsrc(id, body) as (values {rows}), {mine},
qt as (select id as qid, term, 1 + ln(count(*)::double) as weight from qtoks group by id, term),
stat as (select greatest(1, (select count(*) from docs))::double as n, greatest(1.0::double, (select coalesce(sum(doc_len), 0) from lens)::double / greatest(1, (select count(*) from docs))) as mean),
df as (select term, count(*)::double as df from tc group by term),
scored as (
  select qt.qid, tc.id as doc_id, sum(qt.weight * ln(1 + (stat.n - df.df + 0.5::double) / (df.df + 0.5::double)) * (1 + ln(tc.n::double)) * 2.2::double
    / ((1 + ln(tc.n::double)) + 1.2::double * (0.25::double + 0.75::double * lens.doc_len / stat.mean))) as score
  from qt join tc using (term) join df using (term) join lens on lens.id = tc.id cross join stat group by qt.qid, tc.id
)"""


_RELS = _bm25_sql({e: e for e in ENTITIES}) + ", rels as (select qid as entity, doc_id, score / max(score) over (partition by qid) as rel from scored)"
_ARRAY = lambda values: "[" + _quoted(values) + "]"


def _jamo_sql(pad: bool) -> str:
    tails = [hangul.EMPTY_TAIL, *hangul.TAILS[1:]] if pad else hangul.TAILS
    n = "(unicode(c) - 44032)"
    return f"""list_aggregate(list_transform(string_split(term, ''), lambda c: case when regexp_matches(c, '[가-힣]') then
      ({_ARRAY(hangul.LEADS)})[({n} // 588 + 1)::int] || ({_ARRAY(hangul.VOWELS)})[(({n} % 588) // 28 + 1)::int] || ({_ARRAY(tails)})[({n} % 28 + 1)::int]
      else c end), 'string_agg', '')"""


_NEG = " or ".join(f"contains(lower(text), {_quoted([m])})" for m in text.NEGATIONS)
_FRONT = r"(?s)^---\n(.*?)\n---\n"
_FRONT_SQL = "regexp_extract(text, '" + _FRONT.replace("\\n", "\n") + "', 1)"
_SETS = f"""with {_TEXTS}, sets as (select doc_id, list_distinct(list_filter({_words_of("text")}, lambda w: length(w) > 1)) as words, ({_NEG}) as negated from docs),
asked as (select * from sets where doc_id % 100 = 0),
ranked as (
  select a.doc_id as node_id, b.doc_id as other_id, a.words as wa, b.words as wb, a.negated <> b.negated as negation_flip, len(list_intersect(a.words, b.words)) as shared
  from asked a join sets b on a.doc_id <> b.doc_id and list_has_any(a.words, b.words)
),
measured as (
  select node_id, other_id, negation_flip, shared::double / (len(wa) + len(wb) - shared) as jaccard, shared::double / sqrt((len(wa) * len(wb))::double) as cosine from ranked
), conflict as (
  select *, jaccard * (greatest(0.0::double, 1 - cosine) + case when negation_flip then 0.5::double else 0.0::double end) as score from measured
)"""
_HASH = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(0, octet_length(encode(term))), lambda i: ('0x' || substr(hex(encode(term)), (2 * i + 1)::bigint, 2))::hugeint)), lambda h, b: (xor(h::ubigint, b::ubigint)::hugeint * 435 + ((xor(h::ubigint, b::ubigint)::hugeint % 16777216) * 1099511627776)) % 18446744073709551616::hugeint)"
_KOEN = "q"
for _ko, _en in perturb.KO_EN.items():
    _KOEN = f"replace({_KOEN}, '{_ko}', '{_en}')"
_QWORDS = r"list_filter(string_split_regex(trim(q), '\s+'), lambda w: length(w) >= 2 and regexp_matches(w, '^[가-힣]'))"
_LONGEST = f"list_filter({_QWORDS}, lambda w: length(w) = list_max(list_transform({_QWORDS}, lambda v: length(v))))[1]"

def _draw(of: int, *parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '41', {', '.join(parts)})), 1, 8))::bigint % {of})"


_SWAPS = "case {p} " + " ".join(f"when '{a}' then '{b}'" for a, b in perturb.PARTICLE_SWAPS.items()) + " end"
_FORM = f"^(.{{2,}})({'|'.join(sorted(perturb.PARTICLE_SWAPS, key=len, reverse=True))})$"
_TYPOS = rf"""with q as (select doc_id, text as q, md5(text) as k from documents where text is not null),
w as (select doc_id, k, list_filter(string_split_regex(q, '\s+'), lambda w: w <> '') as ws from q),
ww as (select doc_id, k, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from w),
wd as (select *, regexp_matches(w, '{_FORM}') as fits, {_draw(2**31, 'i::varchar', 'k')} as n from ww),
wp as (select *, row_number() over (partition by doc_id order by case when fits then n end nulls last, i) = 1 and fits as hit from wd),
josa as (select doc_id, string_agg(case when hit then regexp_extract(w, '{_FORM}', 1) || {_SWAPS.format(p=f"regexp_extract(w, '{_FORM}', 2)")} else w end, ' ' order by i) as josa, bool_or(hit) as any_hit from wp group by doc_id),
c as (select doc_id, k, unnest(string_split(q, '')) as c, generate_subscripts(string_split(q, ''), 1) - 1 as i from q),
cd as (select *, regexp_matches(c, '[가-힣]') as ko, {_draw(2**31, 'i::varchar', 'k')} as n, 1 + {_draw(2, 'k')} as many from c),
cp as (select *, ko and row_number() over (partition by doc_id order by case when ko then n end nulls last, i) <= many as hit, unicode(c) - 44032 as code,
  {_draw(3, "'kind'", 'i::varchar', 'k')} as kind, {_draw(2**20, "'step'", 'i::varchar', 'k')} as step from cd),
parts as (select *, code // 588 as lead, code % 588 // 28 as vowel, code % 28 as tail from cp),
jamo as (select doc_id, bool_or(hit) as any_hit, string_agg(case when hit then chr((44032 + (case when kind = 2 or (kind = 1 and tail = 0) then (lead + 1 + step % 18) % 19 else lead end) * 588
  + (case when kind = 0 then (vowel + 1 + step % 20) % 21 else vowel end) * 28 + case when kind = 1 then 0 else tail end)::int) else c end, '' order by i) as jamo from parts group by doc_id)
select q.doc_id, case when josa.any_hit then josa.josa end as josa, case when jamo.any_hit then jamo.jamo end as jamo from q left join josa using (doc_id) left join jamo using (doc_id)"""

ORACLES = {
    "query_typos": _TYPOS,
    "tok_words": f"with {_TEXTS} select doc_id, len(ws) as n_words, sha1(coalesce(list_aggregate(ws, 'string_agg', ' '), '')) as digest from (select doc_id, {_words_of('text')} as ws from docs)",
    "tok_filters": f"""with {_TEXTS} select case when w in ({_STOP}) then 'stopword' when length(w) > 6 and regexp_full_match(w, '\\p{{Nd}}+') then 'long number' else 'kept' end as reason, count(*) as n
      from (select unnest(regexp_extract_all(lower(text), '{_CLASS}')) as w from docs) group by 1""",
    "tok_char_ngrams": f"""with {_TEXTS}, ws as (select unnest({_words_of('text')}) as w from docs), c as (select w, count(*) as n from ws group by w)
      select gram, cast(sum(n) as bigint) as n from (select n, unnest(case when regexp_matches(w, '[가-힣]') then {_grams('w', 2)} when length(w) > 3 then {_grams('w', 3)} else [] end) as gram from c) group by gram""",
    "tok_lexical_counts": f"{_COUNTS} select term, cast(sum(n) as bigint) as n_total, count(*) as n_docs from tc group by term",
    "ko_cross_space": f"{_COUNTS} select term, cast(sum(n) as bigint) as n_total, count(*) as n_docs from tc where starts_with(term, '{text.CROSS_MARK}') group by term",
    "doc_len": f"{_COUNTS}, {_LENS} select id as doc_id, cast(doc_len as int) as doc_len from lens",
    "tf_sublinear": f"{_COUNTS} select id as doc_id, term, round(1 + ln(n::double), 6) as tf from tc",
    "title_boost_tf": rf"""with {_TEXTS}, fronts as (select *, {_FRONT_SQL} as front from docs),
      titled as (select doc_id, text, regexp_replace(trim(regexp_extract(front, '(?m)^title:(.*)$', 1), ' '), '^"|"$', '', 'g') as title from fronts where regexp_matches(front, '(?m)^title:')),
      src as (select doc_id as id, title || chr(10) || text as body from titled where title <> ''), tsrc as (select doc_id as id, title as body from titled where title <> ''),
      {tokens_sql('src')}, {_renamed(tokens_sql('tsrc'), 't')},
      tc as (select id, term, 1 + ln(count(*)::double) as tf from toks group by id, term union all select distinct id, term, 1.0::double from ttoks)
      select id as doc_id, count(*) as n_terms, round(sum(tf), 5) as tf_sum from (select id, term, sum(tf) as tf from tc group by id, term) group by id""",
    "df_idf": f"{_COUNTS} select term, count(*) as df, round(ln(1 + ((select count(*) from docs)::double - count(*) + 0.5::double) / (count(*) + 0.5::double)), 6) as idf from tc group by term",
    "bm25_scores": _bm25_sql(QUERY_TEXTS) + " select qid, doc_id, round(score, 6) as score from scored",
    "bm25_topk": _bm25_sql(QUERY_TEXTS) + " select qid, doc_id, round(score, 6) as score, cast(i - 1 as int) as rank from (select *, row_number() over (partition by qid order by round(score, 9) desc, doc_id) as i from scored) where i <= 24",
    "join_and": _RELS + f" select doc_id, round(min(rel), 6) as score from rels group by doc_id having count(*) = {len(ENTITIES)}",
    "join_or": _RELS + f" select doc_id, round(sum(rel) / {len(ENTITIES)}, 6) as score from rels group by doc_id",
    "contradiction_pairs": _SETS
    + """ select node_id, other_id, round(score, 4) as score, round(jaccard, 4) as jaccard, round(cosine, 4) as cosine, negation_flip
      from (select *, row_number() over (partition by node_id order by score desc, other_id) as i from conflict where score >= 0.15) where i <= 5""",
    "negation_flags": f"with {_TEXTS} select doc_id, ({_NEG}) as negated from docs",
    "content_sha": """select doc_id, sha1(concat_ws(chr(31), text, coalesce(kind, 'note'), coalesce(list_aggregate(list_sort(list_filter([source, lang], lambda x: x is not null)), 'string_agg', ','), ''), '',
      '1.000000', 'False', '256:65536', '')) as content_sha from documents where text is not null""",
    "reindex_unchanged": "select doc_id from documents where text is not null and trim(text, ' ') = text",
    "note_parse": rf"""with {_TEXTS}, fronts as (select *, {_FRONT_SQL} as front from docs)
      select doc_id, case when regexp_matches(front, '(?m)^title:') then regexp_replace(trim(regexp_extract(front, '(?m)^title:(.*)$', 1), ' '), '^"|"$', '', 'g') else '' end as title,
        coalesce(list_aggregate(regexp_extract_all(regexp_extract(front, '(?m)^tags:(.*)$', 1), '[\p{{L}}\p{{N}}_]+'), 'string_agg', ','), '') as tags,
        coalesce(list_aggregate(list_transform(regexp_extract_all(text, '\[\[([^\]|]+)', 1), lambda x: trim(x, ' ')), 'string_agg', ','), '') as links,
        sha1(regexp_replace(regexp_replace(text, '{_FRONT}', ''), '^\s+|\s+$', '', 'g')) as body_sha from fronts""",
    "ko_jamo": f"select tid, {_jamo_sql(False)} as jamo, {_jamo_sql(True)} as padded from terms",
    "ko_strip_suffix": f"with {_TEXTS} select word, {_strip_of('word')} as stem from (select distinct unnest({_words_of('text')}) as word from docs)",
    "fnv_bucket": f"select tid, cast(h % 65536 as bigint) as b1, cast(xor((h // 4294967296)::ubigint, (h % 4294967296)::ubigint) % 65536 as bigint) as b2 from (select tid, {_HASH} as h from terms where term is not null)",
    "query_perturbations": f"""with q as (select doc_id, text as q from documents where text is not null)
      select doc_id, case when contains(q, ' ') then replace(q, ' ', '') end as spacing, case when len({_QWORDS}) >= 2 and {_LONGEST} <> trim(q) then {_LONGEST} end as compound,
        case when {_KOEN} <> q then {_KOEN} end as koen,
        case when len(string_split_regex(trim(q), '\\s+')) >= 4 then list_aggregate(string_split_regex(trim(q), '\\s+')[1:2], 'string_agg', ' ') end as homonym from q""",
    "stored_text": f"with {_TEXTS} select doc_id, sha1(text) as kept_sha from docs",
}
