"""The driver's queries, and the SQL of those that SQL can express.

Queries run over whole tables.  Those with SQL read words of the text as it is (no masking), as the SQL does; texts of the
test tables are composed already.  The SQL is written from the semantics, not from the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.words import level, stems_from_tokens, word_attributes
from ..language import french
from ..operators import assemble, echo, repetition, scope, tokens, weak
from ..settings import Settings
from ..sources.lexicon import LEAST_BEFORE, Family, Lexicon, compile_entries, default_lexicon
from .analyze import analyze, phrase_echoes

S = Settings()
PLAIN = Settings(use_stemming=False)


def docs(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def plain_tokens(spark, sf_dir: str) -> DataFrame:
    return tokens.tokens(docs(spark, sf_dir), mask=False)


def plain_kinds(spark, sf_dir: str) -> DataFrame:
    return tokens.classified(plain_tokens(spark, sf_dir), S)


# -- SQL fragments: the relation of words -----------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}\p{M}]+"
_TOKENS = rf"""
n as (select doc_id, translate(coalesce(text, ''), chr(8216)||chr(8217)||chr(700)||chr(160)||chr(8239)||chr(8199)||chr(8201), '''''''    ') as text from documents),
a as (select doc_id, text, regexp_extract_all(text, '[^\p{{L}}\p{{N}}\p{{M}}]*{_WORD}') as w from n),
b as (select doc_id, text, unnest(w) as piece, generate_subscripts(w, 1) - 1 as idx from a),
c as (select doc_id, cast(idx as integer) as idx, regexp_extract(piece, '{_WORD}$') as surface, regexp_extract(piece, '^[^\p{{L}}\p{{N}}\p{{M}}]*') as gap,
  cast(sum(length(piece)) over (partition by doc_id order by idx) as integer) as stop from b),
t as (select doc_id, idx, stop - length(surface) as begin, stop, surface, nfc_normalize(lower(surface)) as norm, regexp_matches(surface, '^\p{{Lu}}') as capitalized,
  idx = 0 or regexp_matches(gap, '[.!?…;:\n]') as hard, gap from c),
tok as (select doc_id, idx, cast(begin as integer) as begin, stop, surface, norm, capitalized, hard or regexp_matches(gap, '[«“"—–(]|--') as sentence_start,
  cast(sum(hard::int) over (partition by doc_id order by idx) as integer) as segment,
  cast(sum((idx > 0 and contains(gap, chr(10)))::int) over (partition by doc_id order by idx) as integer) as paragraph from t)
"""
_STOP = ", ".join(f"('{w}')" for w in sorted(french.STOPWORDS))
_KINDS = (
    _TOKENS
    + f""",
stop_words(w) as (values {_STOP}),
names as (select distinct doc_id, norm from tok where capitalized and not sentence_start and length(norm) >= 3 and norm not in (select w from stop_words)),
k as materialized (select tok.*, case when names.norm is not null then 2 when length(tok.norm) >= 3 and regexp_matches(tok.norm, '\\p{{L}}') and tok.norm not in (select w from stop_words) then 1 else 0 end as kind
  from tok left join names on tok.doc_id = names.doc_id and tok.norm = names.norm)
"""
)


def _level(d: str) -> str:
    return f"case when cast({d} as double) / 80 <= cast(0.2 as double) then 3 when cast({d} as double) / 80 <= cast(0.5 as double) then 2 else 1 end"


_SAME = (
    _KINDS
    + f""",
near as (select doc_id, idx, norm, lag(idx) over w as a, lead(idx) over w as b from k where kind = 1 window w as (partition by doc_id, norm order by idx)),
same as (select doc_id, idx, a as other, {_level("idx - a")} as level, idx as event from near where idx - a <= 80
  union all select doc_id, idx, b as other, {_level("b - idx")} as level, b as event from near where b - idx <= 80),
lev as materialized (select * from (select *, row_number() over (partition by doc_id, idx order by level desc, event) as r from same) where r = 1)
"""
)
_GRAMS = (
    _KINDS
    + """,
g2 as (select doc_id, idx, 2 as size, norm || ' ' || lead(norm) over w as phrase, (kind = 1)::int + (lead(kind) over w = 1)::int as f, greatest(kind, lead(kind) over w) as m, lead(idx, 1) over w as last from k window w as (partition by doc_id, segment order by idx)),
g3 as (select doc_id, idx, 3 as size, norm || ' ' || lead(norm) over w || ' ' || lead(norm, 2) over w as phrase, 2 as f, greatest(kind, lead(kind) over w, lead(kind, 2) over w) as m, lead(idx, 2) over w as last from k window w as (partition by doc_id, segment order by idx)),
g4 as (select doc_id, idx, 4 as size, norm || ' ' || lead(norm) over w || ' ' || lead(norm, 2) over w || ' ' || lead(norm, 3) over w as phrase, 2 as f, greatest(kind, lead(kind) over w, lead(kind, 2) over w, lead(kind, 3) over w) as m, lead(idx, 3) over w as last from k window w as (partition by doc_id, segment order by idx)),
g as (select doc_id, idx, size, phrase from (from g2 union all from g3 union all from g4) where last is not null and m < 2 and f >= 2)
"""
)
_WALK = (
    _GRAMS
    + """,
o as (select *, row_number() over (partition by doc_id, size, phrase order by idx) as r, count(*) over (partition by doc_id, size, phrase) as c from g),
walk as (select doc_id, size, phrase, r, idx, idx as kept, cast(null as integer) as other from o where r = 1 and c > 1
  union all select o.doc_id, o.size, o.phrase, o.r, o.idx, case when o.idx - walk.kept >= o.size then o.idx else walk.kept end, case when o.idx - walk.kept >= o.size then walk.kept end
  from walk join o on o.doc_id = walk.doc_id and o.size = walk.size and o.phrase = walk.phrase and o.r = walk.r + 1),
pairs as (select doc_id, size, phrase, idx, other, idx - other as distance from walk where other is not null and idx - other <= 80)
"""
)
_VERBS = ", ".join(f"('{f}', '{lemma}')" for f, lemma in sorted(french.verb_table().items()))


def _t(body: str, head: str) -> str:
    return f"with recursive {head.strip()}\n{body}"


# -- queries ----------------------------------------------------------------------------------------------------------


def q_tokens(spark, d):
    return plain_tokens(spark, d).select("doc_id", "idx", "begin", "stop", "surface", "norm")


def q_segments(spark, d):
    t = plain_tokens(spark, d)
    return t.groupBy("doc_id", "segment").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_words"))


def q_sentence_starts(spark, d):
    return plain_tokens(spark, d).where("sentence_start").select("doc_id", "idx", "capitalized")


def q_paragraphs(spark, d):
    return plain_tokens(spark, d).groupBy("doc_id", "paragraph").agg(F.count("*").alias("n_words"))


def q_normalize(spark, d):
    return docs(spark, d).select("doc_id", F.length(T.normalize(F.col("text"))).cast("long").alias("n"), F.md5(T.normalize(F.col("text"))).alias("digest"))


def q_proper_names(spark, d):
    return tokens.proper_names(plain_tokens(spark, d))


def q_kinds(spark, d):
    return plain_kinds(spark, d).groupBy("doc_id").pivot("kind", [0, 1, 2]).count().na.fill(0).toDF("doc_id", "n_function", "n_full", "n_excluded")


def q_same_form(spark, d):
    return repetition.same_form(plain_kinds(spark, d), S).select("doc_id", "idx", "other", "level")


def q_word_levels(spark, d):
    return repetition.word_levels(plain_kinds(spark, d), PLAIN).select("doc_id", "idx", "word_level", "word_other")


def q_histogram(spark, d):
    return q_word_levels(spark, d).groupBy("word_level").agg(F.count("*").alias("n"))


def q_explanations(spark, d):
    k = plain_kinds(spark, d)
    lev = repetition.word_levels(k, PLAIN).join(k.select("doc_id", "idx", "surface"), ["doc_id", "idx"])
    before = F.col("word_other") < F.col("idx")
    place = assemble.where_is(F.abs(F.col("idx") - F.col("word_other")), before)
    head = F.concat(assemble.quoted(F.col("surface")), F.when(before, " apparaît déjà ").otherwise(" revient "))
    return lev.select("doc_id", "idx", F.concat(head, place, F.lit(".")).alias("explanation"), F.length(head).alias("link_from"), (F.length(head) + F.length(place)).alias("link_to"))


def q_ngrams(spark, d):
    c = repetition.phrase_candidates(plain_kinds(spark, d), S)
    return c.groupBy("doc_id", "size", "phrase").agg(F.count("*").alias("n")).where("n > 1")


def q_phrase_pairs(spark, d):
    return repetition.phrase_pairs(plain_kinds(spark, d), S).select("doc_id", "size", "phrase", "idx", "other", "distance")


def q_phrase_ranges(spark, d):
    k = plain_kinds(spark, d)
    m = k.join(repetition.phrase_levels(k, S), ["doc_id", "idx"], "left").withColumn("word_level", F.lit(None).cast("int"))
    return assemble.phrase_ranges(m).select("doc_id", "first", "last", "family", "intensity")


def q_verb_lemmas(spark, d):
    t = plain_tokens(spark, d).select("norm")
    counts = t.groupBy("norm").agg(F.count("*").alias("n"))
    return counts.withColumn("lemma", word_attributes("norm")["lemma"]).where("lemma is not null").select("norm", "lemma", "n")


def q_stems(spark, d):
    counts = plain_tokens(spark, d).groupBy("norm").agg(F.count("*").alias("n"))
    return counts.withColumn("w", word_attributes("norm")).select("norm", "w.stem", "w.alt", "w.lemma", "n")


def q_stem_repetitions(spark, d):
    return repetition.same_stem_events(repetition.attributed(plain_kinds(spark, d)), S)


def q_commonness(spark, d):
    return stems_from_tokens(plain_tokens(spark, d))


def q_families(spark, d):
    m = repetition.with_family(repetition.attributed(plain_kinds(spark, d)), S)
    return m.where("kind = 1").groupBy("doc_id", "family").agg(F.count("*").alias("n"), F.countDistinct("norm").alias("forms")).where("forms > 1")


def q_rare_echoes(spark, d):
    """Echoes by form, with the corpus' own rates as rarity: occurrences per million words of the table, in the usual bands."""
    k = plain_kinds(spark, d)
    often = k.groupBy("norm").agg(F.count("*").alias("n"))
    total = often.agg(F.sum("n").alias("total"))
    often = often.crossJoin(F.broadcast(total)).select("norm", level(F.col("n") * 1e6 / F.col("total")).alias("common"))  # one row
    m = k.join(often, "norm").withColumns({"family": F.col("norm"), "p": F.lit(None)})
    m = m.join(repetition.word_levels(k, PLAIN), ["doc_id", "idx"], "left")
    return echo.word_echoes(m, S).select("doc_id", "idx", "echo_other")


def q_phrase_echoes(spark, d):
    return phrase_echoes(docs(spark, d), S)


#: English and German stand-ins, since the test tables are in four languages: endings, words, a phrase.
TEST_LEXICON = Lexicon([Family("endings", "Endings", 2, ["*tion", "*heit"], ["ention"]), Family("words", "Words", None, ["was", "der", "les", "que"], [])])


def q_weak_density(spark, d):
    h = weak.weak_hits(plain_tokens(spark, d), TEST_LEXICON, S)
    return h.groupBy("doc_id", "paragraph", "rank").agg(F.count("*").alias("n"))


def q_weak_highlights(spark, d):
    return weak.weak_highlights(plain_tokens(spark, d), TEST_LEXICON, S).select("doc_id", "idx", "rank", "count", "intensity")


def q_weak_default(spark, d):
    return weak.weak_highlights(plain_tokens(spark, d), default_lexicon(), S).select("doc_id", "idx", "size", "rank", "count", "intensity")


def q_masked_docs(spark, d):
    return tokens.tokens(docs(spark, d)).select("doc_id", "idx", "begin", "stop", "norm", "segment", "paragraph")


def q_masked_pages(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return tokens.tokens(p).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.max("segment").alias("n_segments"))


def q_conversations(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    key = ("conv_id", "turn")
    return repetition.same_form(tokens.classified(tokens.tokens(c, key, mask=False), S, key), S, key).groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


def q_scope(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    path = F.regexp_replace(F.col("url"), r"^https?://[^/]*/", "")
    s = Settings(included_folders="en\nfr", excluded_folders="en/8")
    return p.select("page_id", path.alias("path"), F.coalesce(scope.exclusion_of(path, None, s), F.lit("none")).alias("exclusion"))


def q_highlights(spark, d):
    return analyze(docs(spark, d), color=False).select("doc_id", "begin", "stop", "surface", "category", "family", "intensity", "target_begin", "target_stop", F.col("explanation.text").alias("explanation"))


def q_summary(spark, d):
    return analyze(docs(spark, d), color=False, explain=False).groupBy("category", "intensity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def q_colors(spark, d):
    return analyze(docs(spark, d), explain=False).select("doc_id", "begin", "stop", "family", "color")


def q_metrics(spark, d):
    k = plain_kinds(spark, d)
    words = k.groupBy("doc_id").agg(F.count("*").alias("n_words"))
    marks = q_word_levels(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_marks"))
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return labels.join(words, "doc_id").join(marks, "doc_id", "left").select("doc_id", "quality", "n_words", F.coalesce("n_marks", F.lit(0)).alias("n_marks"), (F.coalesce("n_marks", F.lit(0)) * 1000 / F.col("n_words")).alias("per_thousand"))


QUERIES = {
    "tokens": q_tokens, "segments": q_segments, "sentence_starts": q_sentence_starts, "paragraphs": q_paragraphs, "normalize_typography": q_normalize,
    "masked_tokens_docs": q_masked_docs, "masked_tokens_pages": q_masked_pages, "proper_names": q_proper_names, "word_kinds": q_kinds,
    "same_form_repetitions": q_same_form, "word_levels": q_word_levels, "repetition_intensity_histogram": q_histogram, "explanations": q_explanations,
    "ngram_counts": q_ngrams, "phrase_repetitions": q_phrase_pairs, "phrase_ranges": q_phrase_ranges, "verb_lemmas": q_verb_lemmas, "stems": q_stems,
    "stem_repetitions": q_stem_repetitions, "commonness": q_commonness, "families": q_families, "rare_echoes": q_rare_echoes, "phrase_echoes": q_phrase_echoes,
    "weak_density": q_weak_density, "weak_highlights": q_weak_highlights, "weak_default": q_weak_default, "conversations": q_conversations,
    "scope_filter": q_scope, "highlights": q_highlights, "highlight_summary": q_summary, "colors": q_colors, "doc_metrics": q_metrics,
}

_WEAK = (
    _TOKENS
    + """,
h as (select doc_id, idx, paragraph, case when norm in ('was', 'der', 'les', 'que') then 1 when length(norm) >= 7 and (norm like '%tion' or norm like '%heit') and norm <> 'ention' then 0 end as rank from tok),
hc as (select *, cast(count(*) over (partition by doc_id, paragraph, rank) as integer) as n from h where rank is not null)
"""
)


def _lexicon_sql(lexicon: Lexicon) -> str:
    """Entries, forms and endings of a lexicon as tables, and its hits: candidates at each word, taken from the left."""
    entries = compile_entries(lexicon)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    places = [(n, k, x) for n, e in enumerate(entries) for k, x in enumerate(e.elements)]
    forms = ", ".join(f"({n}, {k}, {quoted(f)})" for n, k, x in places for f in sorted(x.forms))
    endings = ", ".join(f"({n}, {k}, {quoted(x.ending)}, [{', '.join(quoted(w) for w in sorted(x.exceptions))}]::varchar[])" for n, k, x in places if x.ending)
    entry = ", ".join(f"({n}, {e.rank}, {len(e.elements)}, {not e.pattern})" for n, e in enumerate(entries))
    limits = ", ".join(f"({k}, {S.weak_threshold if f.threshold is None else f.threshold})" for k, f in enumerate(lexicon.families))
    return f""",
entry(n, rank, words, exact) as (values {entry}), forms(n, place, form) as (values {forms}), endings(n, place, ending, barred) as (values {endings}), limits(rank, l) as (values {limits}),
fit as (select doc_id, segment, paragraph, idx, n, place from tok join forms on norm = form
  union select doc_id, segment, paragraph, idx, n, place from tok join endings on ends_with(norm, ending) and length(norm) >= length(ending) + {LEAST_BEFORE} and not list_contains(barred, norm)),
matched as (select doc_id, segment, cast(idx - place as integer) as idx, n, min(paragraph) filter (place = 0) as paragraph, count(*) as c from fit group by doc_id, segment, idx - place, n),
scored as (select doc_id, segment, paragraph, idx, rank, words, row_number() over (partition by doc_id, idx order by words desc, exact desc, rank) as r from matched join entry using (n) where c = words),
cand as (select doc_id, segment, paragraph, idx, rank, words, row_number() over (partition by doc_id, segment order by idx) as r from scored where r = 1),
taken as (select *, idx + words as over, true as kept from cand where r = 1
  union all select c.*, case when c.idx >= t.over then c.idx + c.words else t.over end, c.idx >= t.over from taken t join cand c on c.doc_id = t.doc_id and c.segment = t.segment and c.r = t.r + 1),
shown as (select doc_id, idx, words, rank, cast(count(*) over (partition by doc_id, paragraph, rank) as integer) as n from taken where kept)
"""


ORACLES = {
    "tokens": _t("select doc_id, idx, begin, stop, surface, norm from tok", _TOKENS),
    "segments": _t("select doc_id, segment, min(idx) as first_idx, max(idx) as last_idx, count(*) as n_words from tok group by all", _TOKENS),
    "sentence_starts": _t("select doc_id, idx, capitalized from tok where sentence_start", _TOKENS),
    "paragraphs": _t("select doc_id, paragraph, count(*) as n_words from tok group by all", _TOKENS),
    "normalize_typography": _t("select doc_id, length(text) as n, md5(text) as digest from n", _TOKENS),
    "proper_names": _t("select doc_id, norm from names", _KINDS),
    "word_kinds": _t("select doc_id, count(*) filter (kind = 0) as n_function, count(*) filter (kind = 1) as n_full, count(*) filter (kind = 2) as n_excluded from k group by doc_id", _KINDS),
    "same_form_repetitions": _t("select doc_id, idx, other, level from same", _SAME),
    "word_levels": _t("select doc_id, idx, level as word_level, other as word_other from lev", _SAME),
    "repetition_intensity_histogram": _t("select level as word_level, count(*) as n from lev group by level", _SAME),
    "explanations": _t(
        """, e as (select lev.doc_id, lev.idx, '« ' || surface || ' »' || case when other < lev.idx then ' apparaît déjà ' else ' revient ' end as head,
  case when abs(lev.idx - other) = 1 then case when other < lev.idx then 'juste avant' else 'juste après' end else abs(lev.idx - other) || ' mots plus ' || case when other < lev.idx then 'haut' else 'loin' end end as place
  from lev join k on lev.doc_id = k.doc_id and lev.idx = k.idx)
select doc_id, idx, head || place || '.' as explanation, cast(length(head) as integer) as link_from, cast(length(head) + length(place) as integer) as link_to from e""",
        _SAME,
    ),
    "ngram_counts": _t("select doc_id, size, phrase, count(*) as n from g group by all having count(*) > 1", _GRAMS),
    "phrase_repetitions": _t("select doc_id, size, phrase, idx, other, distance from pairs", _WALK),
    "phrase_ranges": _t(
        f""", e as (select doc_id, size, phrase, idx as event, least(3, {_level("distance")} + (size >= 3)::int) as level, idx as start, other from pairs
  union all select doc_id, size, phrase, idx, least(3, {_level("distance")} + (size >= 3)::int), other, idx from pairs),
under as (select *, unnest(range(start, start + size)) as place from e),
best as (select *, row_number() over (partition by doc_id, place order by level desc, size, event, start desc, other desc, phrase desc) as r from under),
runs as (select k.doc_id, segment, idx, level, phrase, idx - row_number() over (partition by k.doc_id, segment order by idx) as island from best join k on best.doc_id = k.doc_id and place = idx where r = 1)
select doc_id, cast(min(idx) as integer) as first, cast(max(idx) as integer) as last, arg_max(phrase, cast(level as bigint) * 1000000000 - idx) as family, cast(max(level) as integer) as intensity
from runs group by doc_id, segment, island""",
        _WALK,
    ),
    "verb_lemmas": _t(f", v(norm, lemma) as (values {_VERBS}) select tok.norm, v.lemma, count(*) as n from tok join v on tok.norm = v.norm group by all", _TOKENS),
    "rare_echoes": _t(
        """, often as (select norm, count(*) * cast(1000000 as double) / (select count(*) from k) as per_million from k group by norm),
rare as (select k.doc_id, k.idx, lag(k.idx) over w as a, lead(k.idx) over w as b from k join often using (norm) where kind = 1 and per_million < 10 window w as (partition by k.doc_id, k.norm order by k.idx)),
cut as (select doc_id, idx, case when idx - a <= 5000 then a end as a, case when b - idx <= 5000 then b end as b from rare)
select doc_id, idx, case when b is null or idx - a <= b - idx then a when a is null then b else b end as echo_other from cut
where (a is not null or b is not null) and not exists (select 1 from lev where lev.doc_id = cut.doc_id and lev.idx = cut.idx)""",
        _SAME,
    ),
    "weak_density": _t("select doc_id, paragraph, rank, count(*) as n from hc group by all", _WEAK),
    "weak_highlights": _t(
        "select doc_id, idx, rank, n as count, case when n >= 2 * l then 3 when n > l then 2 else 1 end as intensity from (select *, case rank when 0 then 2 else 3 end as l from hc) where n >= l",
        _WEAK,
    ),
    "weak_default": _t(
        "select doc_id, idx, cast(words as integer) as size, rank, n as count, case when n >= 2 * l then 3 when n > l then 2 else 1 end as intensity from shown join limits using (rank) where n >= l",
        _TOKENS + _lexicon_sql(default_lexicon()),
    ),
    "conversations": _t(
        "select doc_id.conv_id as conv_id, doc_id.turn as turn, count(*) as n from same group by all",
        "documents as (select {'conv_id': conv_id, 'turn': turn} as doc_id, text from conversations),\n" + _SAME.strip(),
    ),
    "scope_filter": """with p as (select page_id, regexp_replace(url, '^https?://[^/]*/', '') as path from pages)
select page_id, path, case when starts_with(lower(path), 'en/8/') then 'folder' when starts_with(lower(path), 'en/') or starts_with(lower(path), 'fr/') then 'none' else 'folder' end as exclusion from p""",
    "doc_metrics": _t(
        """, m as (select doc_id, count(*) as n_marks from lev group by doc_id), w as (select doc_id, count(*) as n_words from tok group by doc_id)
select l.doc_id, l.quality, w.n_words, coalesce(m.n_marks, 0) as n_marks, coalesce(m.n_marks, 0) * 1000 / cast(w.n_words as double) as per_thousand
from labels l join w on l.doc_id = w.doc_id left join m on m.doc_id = l.doc_id""",
        _SAME,
    ),
}


def flagship(spark, sf_dir: str) -> DataFrame:
    """Repeated words, with what each repeats and how strongly."""
    k = plain_kinds(spark, sf_dir)
    levels = repetition.word_levels(k, PLAIN)
    w = Window.partitionBy("doc_id")
    return levels.join(k.select("doc_id", "idx", "begin", "stop", "surface"), ["doc_id", "idx"]).withColumn("in_document", F.count("*").over(w))
