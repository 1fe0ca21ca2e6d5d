"""Patterns, keywords, n-grams, TF-IDF and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.signal_checks import rounded
from checks.sql import LABELS, SEEDED, quote, words
from promptsieve import lexicon as L
from promptsieve.operators import keywords as K
from promptsieve.operators import patterns as P
from promptsieve.operators import summaries as SM
from promptsieve.operators import tfidf as TF
from promptsieve.sources import tables as T
from promptsieve.streaming.feedback import shared_folder

WORD_FEATURES, CHAR_FEATURES = 5000, 10000


def prompts(spark, sf):
    """Seeded texts with labels."""
    return T.seeded_texts(spark, sf).join(T.labels(spark, sf), "prompt_id", "left")


def turns(spark, sf):
    """Conversation turns as texts that were not part of any fit."""
    return T.spread(T.table(spark, sf, "conversations"), "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"),
        F.coalesce("text", F.lit("")).alias("prompt_text"),
    )


def tracked_by_day(spark, sf):
    """The same from stored summaries of seven days, by id, of which the last is written twice."""
    days = traffic(spark, sf).withColumn("day", F.col("prompt_id") % 7)
    folder = shared_folder(spark, "ngram-days")
    for part in (days, days.where("day = 6")):
        SM.store(K.summarise_ngrams(part, "day"), folder)
    return K.track_ngrams(days.drop("day", "prompt_id"), summary=spark.read.parquet(folder).select("cell", "n"))


def traffic(spark, sf):
    """Texts blocked by the pattern gate."""
    return P.flag_by_gate(T.seeded_texts(spark, sf), "blocked")


# One expression per pattern, so the engine compiles each regex once.
_SCORE = "greatest(0.0, " + ", ".join(
    f"case when regexp_matches(prompt_text, {quote('(?i)' + p)}) then {s} else 0.0 end" for p, s in L.PATTERN_SCORES.items()
) + ")"
SCORED = f"{SEEDED}, pat as (select prompt_id, prompt_text, cast({_SCORE} as double) as pattern_score from seeded)"
_HITS = " union all ".join(
    f"select prompt_id, {quote(p)} as pattern, cast({s} as double) as score, "
    f"cast(strpos(prompt_text, regexp_extract(prompt_text, {quote('(?i)' + p)})) - 1 as integer) as \"offset\" "
    f"from seeded where regexp_matches(prompt_text, {quote('(?i)' + p)})"
    for p, s in L.PATTERN_SCORES.items()
)

LABELLED = f"{SEEDED}, {LABELS}, p as (select s.*, l.is_malicious from seeded s join labelled l using (prompt_id))"
KEYWORDS = f"""{LABELLED},
w as (select distinct prompt_id, is_malicious, unnest({words('prompt_text')}) as word from p),
kc as (select word, count(case when is_malicious = 1 then 1 end) as df, count(case when is_malicious <> 1 then 1 end) as safe_df from w group by 1),
kw as (select word, df, safe_df, ln(((select count(*) from p) - df + 0.5) / cast(df + 0.5 as double) + 1) * df / (df + safe_df + 1) as weight from kc where df >= 3)"""


def terms_sql(analyzer: str, source: str) -> str:
    """(prompt_id, term, tf) of a CTE with prompt_id and prompt_text."""
    if analyzer == "word":
        return f"""tk_{source} as (select prompt_id, regexp_extract_all(lower(prompt_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as k from {source}),
tm_{source} as (select prompt_id, term, count(*) as tf from (
  select prompt_id, unnest(k) as term from tk_{source} union all
  select prompt_id, k[i] || ' ' || k[i + 1] from (select prompt_id, k, unnest(range(1, len(k))) as i from tk_{source})) group by all)"""
    return f"""tw_{source} as (select prompt_id, ' ' || x || ' ' as x from (select prompt_id, unnest({words('prompt_text')}) as x from {source})),
tm_{source} as (select prompt_id, term, count(*) as tf from (
  select prompt_id, substr(x, i, n) as term from (select prompt_id, x, n, unnest(range(1, length(x) - n + 2)) as i
    from tw_{source}, (select unnest([3, 4, 5]) as n) where length(x) >= n)) group by all)"""


def vocab_sql(analyzer: str, source: str, size: int) -> str:
    return f"""{terms_sql(analyzer, source)},
voc as (select term, cast(sum(tf) as bigint) as tf, count(*) as df from tm_{source} group by 1 order by 2 desc, 1 limit {size}),
vocab as (select term, tf, df, ln((1 + (select count(*) from {source})) / cast(1 + df as double)) + 1 as idf from voc)"""


def weights_sql(source: str) -> str:
    return f"""raw_{source} as (select prompt_id, v.term, (1 + ln(t.tf)) * idf as w from tm_{source} t join vocab v using (term)),
wt_{source} as (select prompt_id, term, w / sqrt(sum(w * w) over (partition by prompt_id)) as weight from raw_{source})"""


def centroid_sql(analyzer: str, size: int) -> str:
    return f"""{LABELLED}, {vocab_sql(analyzer, 'p', size)}, {weights_sql('p')},
cs as (select term, sum(weight) as s from wt_p join p using (prompt_id) where is_malicious = 1 group by 1),
cent as (select term, s / sqrt(sum(s * s) over ()) as weight, cast(trunc(s / sqrt(sum(s * s) over ()) * 127) as tinyint) as quantised from cs)"""


def similarity_sql(analyzer: str, size: int) -> str:
    return f"""with {centroid_sql(analyzer, size)},
dots as (select prompt_id, sum(trunc(wt_p.weight * 127) * coalesce(quantised, 0)) as d from wt_p left join cent using (term) group by 1)
select prompt_id, round(case when d is null then 0 else 1 / (1 + exp(-5 * (d / cast(16129 as double) - 0.3))) end, 6) as similarity from p left join dots using (prompt_id)"""


def _centroid(spark, sf, size, analyzer):
    frame = prompts(spark, sf)
    model = TF.TfidfModel.fit(frame, size, analyzer)
    names = TF.V.literal(model.terms, "string")
    found = TF.malicious_centroid(frame, model)
    return rounded(found.select(F.get(names, F.col("term_id")).alias("term"), "weight", "quantised"))


def _similarity(size, analyzer):
    def run(spark, sf):
        frame = prompts(spark, sf)
        return rounded(TF.Similarity.fit(frame, size, analyzer).score(frame))
    return run


def _blended(spark, sf):
    frame = prompts(spark, sf)
    word = TF.Similarity.fit(frame, WORD_FEATURES, "word")
    char = TF.Similarity.fit(frame, CHAR_FEATURES, "char")
    return rounded(TF.blended_similarity(frame, word, char))


def _keyword_scores(spark, sf):
    frame = prompts(spark, sf)
    target = shared_folder(spark, "keywords")
    K.fit_keywords(frame).write.parquet(target)
    return rounded(K.score_keywords(frame, spark.read.parquet(target)))


QUERIES = {
    "pattern_score": lambda s, sf: P.pattern_scores(T.seeded_texts(s, sf)),
    "pattern_hits": lambda s, sf: P.pattern_hits(T.seeded_texts(s, sf)),
    "keyword_weights": lambda s, sf: rounded(K.fit_keywords(prompts(s, sf))),
    "keyword_scores": _keyword_scores,
    "ngram_tracking": lambda s, sf: rounded(K.track_ngrams(traffic(s, sf))),
    "ngram_tracking_daily": lambda s, sf: rounded(tracked_by_day(s, sf)),
    "ngram_proposals": lambda s, sf: rounded(K.propose_ngrams(K.track_ngrams(traffic(s, sf)), 20)),
    "tfidf_word_vocabulary": lambda s, sf: rounded(TF.vocabulary(T.seeded_texts(s, sf), WORD_FEATURES, "word")),
    "tfidf_char_vocabulary": lambda s, sf: rounded(TF.vocabulary(T.seeded_texts(s, sf), CHAR_FEATURES, "char")),
    "tfidf_word_weights": lambda s, sf: rounded(
        TF.TfidfModel.fit(T.seeded_texts(s, sf), WORD_FEATURES).long(T.seeded_texts(s, sf))),
    "tfidf_transform_new": lambda s, sf: rounded(
        TF.TfidfModel.fit(T.seeded_texts(s, sf), WORD_FEATURES).long(turns(s, sf))),
    "tfidf_malicious_centroid": lambda s, sf: _centroid(s, sf, WORD_FEATURES, "word"),
    "similarity_word": _similarity(WORD_FEATURES, "word"),
    "similarity_char": _similarity(CHAR_FEATURES, "char"),
    "similarity_blended": _blended,
}

_TRACKED = f"""{SCORED},
tr as (select prompt_id, cast(pattern_score >= cast(0.6 as double) as integer) as blocked, {words('prompt_text')} as w from pat),
ng as (select blocked, w[i] || ' ' || w[i + 1] as ngram from (select blocked, w, unnest(range(1, len(w))) as i from tr) union all
       select blocked, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from (select blocked, w, unnest(range(1, len(w) - 1)) as i from tr)),
nc as (select ngram, count(case when blocked = 1 then 1 end) as blocked, count(case when blocked = 0 then 1 end) as allowed from ng group by 1),
np as (select *, blocked / cast(blocked + allowed + 1 as double) as precision from nc where blocked >= 5),
tracked as (select * from np where precision >= cast(0.7 as double))"""
_TURNS = "turns as (select conv_id * 1000 + turn as prompt_id, coalesce(text, '') as prompt_text from conversations)"

ORACLES = {
    "pattern_score": f"with {SCORED} select prompt_id, pattern_score, case when pattern_score >= cast(0.6 as double) then pattern_score else 0 end as pattern_gated from pat",
    "pattern_hits": f"with {SEEDED} {_HITS}",
    "keyword_weights": f"with {KEYWORDS} select word, df, safe_df, round(weight, 6) as weight from kw",
    "keyword_scores": f"""with {KEYWORDS}, x as (select prompt_id, unnest({words('prompt_text')}) as word from p),
s as (select prompt_id, sum(coalesce(weight, 0)) as s, count(*) as n from x left join kw using (word) group by 1)
select prompt_id, round(case when n is null then 0 else 1 / (1 + exp(-10 * (s / cast(n as double) - 0.1))) end, 6) as keyword_score from p left join s using (prompt_id)""",
    "ngram_tracking": f"with {_TRACKED} select ngram, blocked, allowed, round(precision, 6) as precision from tracked",
    "ngram_tracking_daily": f"with {_TRACKED} select ngram, blocked, allowed, round(precision, 6) as precision from tracked",
    "ngram_proposals": f"with {_TRACKED}, k as (select * from tracked order by precision desc, blocked desc, ngram limit 20) select ngram, blocked, allowed, round(precision, 6) as precision from k",
    "tfidf_word_vocabulary": f"with {SEEDED}, {vocab_sql('word', 'seeded', WORD_FEATURES)} select term, tf, df, round(idf, 6) as idf from vocab",
    "tfidf_char_vocabulary": f"with {SEEDED}, {vocab_sql('char', 'seeded', CHAR_FEATURES)} select term, tf, df, round(idf, 6) as idf from vocab",
    "tfidf_word_weights": f"with {SEEDED}, {vocab_sql('word', 'seeded', WORD_FEATURES)}, {weights_sql('seeded')} select prompt_id, term, round(weight, 6) as weight from wt_seeded",
    "tfidf_transform_new": f"with {SEEDED}, {_TURNS}, {vocab_sql('word', 'seeded', WORD_FEATURES)}, {terms_sql('word', 'turns')}, {weights_sql('turns')} select prompt_id, term, round(weight, 6) as weight from wt_turns",
    "tfidf_malicious_centroid": f"with {centroid_sql('word', WORD_FEATURES)} select term, round(weight, 6) as weight, quantised from cent",
    "similarity_word": similarity_sql("word", WORD_FEATURES),
    "similarity_char": similarity_sql("char", CHAR_FEATURES),
    "similarity_blended": f"""with a as ({similarity_sql('word', WORD_FEATURES)}), b as ({similarity_sql('char', CHAR_FEATURES)})
select prompt_id, greatest(a.similarity, b.similarity) as similarity from a join b using (prompt_id)""",
}
