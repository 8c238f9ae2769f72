"""Lexical and dense retrieval over documents, and the screening of what is retrieved."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenta.operators import injection, retrieval
from lumenta.queries.metrics import rounded
from lumenta.sources import tables

QUERY = "licensed under the apache license"


def _docs(spark, folder):
    return tables.table(spark, folder, "documents").select("doc_id", "text")


def _bm25(spark, folder):
    return rounded(retrieval.bm25_texts(_docs(spark, folder), "doc_id", QUERY))


def _vector(spark, folder):
    """The query: the vector of the least id; none of an empty table."""
    row = tables.table(spark, folder, "embeddings").where("embedding is not null").orderBy("vec_id").first()
    return [float(x) for x in row.embedding] if row else []


def _cosine(spark, folder):
    return rounded(retrieval.dense_cosine(tables.table(spark, folder, "embeddings"), "vec_id", "embedding", _vector(spark, folder)))


def _fused(spark, folder):
    docs = _docs(spark, folder)
    # ranks of rounded scores: the last bits of a sum don't decide
    signals = {"bm25": _bm25(spark, folder), "ngram": rounded(retrieval.char_tfidf(docs, "doc_id", QUERY))}
    return rounded(retrieval.fused(signals, "doc_id").select("doc_id", "rrf", F.array_join("signals", ",").alias("signals"), F.col("places")["bm25"].alias("bm25_place"), F.col("places")["ngram"].alias("ngram_place"), "rank"), 8)


def _stems(spark, folder):
    own = retrieval.tokens(_docs(spark, folder), "doc_id").groupBy("token").agg(F.count("*").alias("n"))
    return own.select("token", retrieval.stem(F.col("token")).alias("term"), "n")


def _chunks(spark, folder):
    return retrieval.chunked(_docs(spark, folder), "doc_id")


def _scan(spark, folder):
    return injection.scanned(_docs(spark, folder)).select("doc_id", F.col("score").cast("int").alias("score"), F.array_join("labels", ",").alias("labels"), "suspicious", "blocked")


QUERIES = {
    "rag_tokens": lambda s, f: retrieval.tokens(_docs(s, f), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct")),
    "rag_stem": _stems,
    "rag_postings": lambda s, f: retrieval.postings(_docs(s, f), "doc_id"),
    "rag_bm25": _bm25,
    "rag_char_tfidf": lambda s, f: rounded(retrieval.char_tfidf(_docs(s, f), "doc_id", QUERY)),
    "rag_dense_cosine": _cosine,
    "rag_rrf": _fused,
    "rag_chunks": _chunks,
    "rag_chunk_id": lambda s, f: _chunks(s, f).select("doc_key", "ordinal", "chunk_id", retrieval.chunk_id(F.col("doc_key"), F.col("ordinal"), F.col("text")).alias("expected")),
    "injection_report": lambda s, f: injection.report(_docs(s, f), "doc_id").select("doc_id", "action", F.col("score").cast("int").alias("score"), F.array_join("labels", ",").alias("labels")),
    "injection_scan": _scan,
    "injection_filter": lambda s, f: injection.admitted(_docs(s, f)).select("doc_id", "suspicious"),
}

_TOKENS = "tok as (select doc_id, t from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9£$%]+')) as t from documents) where length(t) >= 2)"


def _stem(t: str) -> str:
    whens = " ".join(f"when ends_with({t}, '{s}') and length({t}) >= {len(s) + retrieval.LEAST_STEM} then left({t}, length({t}) - {len(s)})" for s in retrieval.SUFFIXES)
    cut = f"(case {whens} else {t} end)"
    return f"case when ends_with({t}, 'ies') and length({t}) >= 5 then left({t}, length({t}) - 3) || 'y' when ends_with({cut}, 'e') and length({cut}) >= 6 then left({cut}, length({cut}) - 1) else {cut} end"


_POSTS = f"{_TOKENS}, cnt as (select doc_id, t, count(*) as n from tok group by all), posts as (select doc_id, {_stem('t')} as term, cast(sum(n) as bigint) as tf from cnt group by all)"
#: A word's edge is one of any letters in Spark, and of ASCII ones in the other engine, so it is spelled out there.
_PATTERNS = [(p.replace(r"\b", r"(?:^|$|[^\pL\pN\pM_])"), label, w) for p, label, w in injection.PATTERNS]


def _scored(select: str, where: str = "") -> str:
    """Flags by pattern, then the score and the sorted labels."""
    cells = ", ".join(f"regexp_matches(coalesce(text, ''), '(?i){p.replace(chr(39), chr(39) * 2)}') as f{i}" for i, (p, _, _) in enumerate(_PATTERNS))
    score = " + ".join(f"case when f{i} then {w} else 0 end" for i, (_, _, w) in enumerate(_PATTERNS))
    labels = ", ".join(f"case when f{i} then '{label}' end" for i, (_, label, _) in enumerate(_PATTERNS))
    return f"with flags as (select doc_id, {cells} from documents), s as (select doc_id, cast({score} as int) as score, array_to_string(list_sort(list_distinct([x for x in [{labels}] if x is not null])), ',') as labels from flags) select {select} from s {where}"


_GRAMS = f"""words as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) as w from documents) where length(w) > 0 group by all),
 ask as (select w, count(*) as n from (select unnest(string_split('{QUERY}', ' ')) as w) group by w)"""


def _cut(rows: str, key: str) -> str:
    parts = " union all ".join(f"select {key} n, unnest([substr(' ' || w || ' ', i::int, {k}) for i in range(1, length(w) + 4 - {k})]) as g from {rows} where length(w) + 2 >= {k}" for k in (3, 4, 5))
    return f"(select {key} g, sum(n) as tf from ({parts}) group by all)"


_CHAR = f"""with {_GRAMS}, grams as {_cut("words", "doc_id,")}, total as (select count(*) as n from documents), idf as (select g, ln((1 + max(total.n)) / (1 + count(*))) + 1 as idf from grams, total group by g),
 q as (select g, (1 + ln(tf)) * idf as qw from {_cut("ask", "")} join idf using (g)), qn as (select sqrt(sum(qw * qw)) as qn from q),
 docs as (select doc_id, sqrt(sum((1 + ln(tf)) * idf * (1 + ln(tf)) * idf)) as dn, sum((1 + ln(tf)) * idf * qw) as dot from grams join idf using (g) left join q using (g) group by doc_id),
 cosines as (select doc_id, round(dot / (dn * qn), 6) as cosine from docs, qn where dot is not null)"""
_BM25 = f"""with {_POSTS}, q as (select {_stem('t')} as term, count(*) as qf from (select unnest(string_split('{QUERY}', ' ')) as t) group by 1), len as (select doc_id, sum(tf) as l from posts group by 1), whole as (select count(*) as n, avg(l) as m from len), hits as (select posts.*, qf, count(*) over (partition by term) as df from posts join q using (term))
 select doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) as bm25 from hits join len using (doc_id), whole group by doc_id"""
ORACLE = {
    "rag_bm25": _BM25,
    "rag_rrf": f"""{_CHAR}, bm as ({_BM25}), places as (select doc_id, 'bm25' as signal, row_number() over (order by bm25 desc, doc_id) as place from bm where bm25 > 0 union all select doc_id, 'ngram', row_number() over (order by cosine desc, doc_id) from cosines where cosine > 0),
 f as (select doc_id, sum(1 / (60 + place)) as rrf, string_agg(signal, ',' order by signal) as signals, max(place) filter (signal = 'bm25') as bm25_place, max(place) filter (signal = 'ngram') as ngram_place from places group by doc_id)
 select doc_id, round(rrf, 8) as rrf, signals, bm25_place, ngram_place, cast(row_number() over (order by round(rrf, 12) desc, doc_id) as int) as rank from f order by rank limit 10""",
    "rag_char_tfidf": f"{_CHAR} select doc_id, cosine from cosines",
    "injection_scan": _scored("doc_id, score, labels, score >= 2 as suspicious, score >= 3 as blocked"),
    "injection_filter": _scored("doc_id, score >= 2 as suspicious", "where score < 3"),
    "injection_report": _scored("doc_id, case when score >= 3 then 'excluded' else 'annotated' end as action, score, labels", "where score >= 2"),
    "rag_tokens": f"with {_TOKENS} select doc_id, count(*) as n_tokens, count(distinct t) as n_distinct from tok group by doc_id",
    "rag_stem": f"with {_TOKENS} select t as token, {_stem('t')} as term, count(*) as n from tok group by t",
    "rag_postings": f"with {_POSTS} select doc_id, term, tf from posts",
    "rag_dense_cosine": "with q as (select embedding::double[] as v from embeddings where vec_id = 0) select vec_id, round(list_inner_product(embedding::double[], v) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(v, v))), 6) as cosine from embeddings, q where list_inner_product(embedding::double[], embedding::double[]) > 0",
}
