"""From text to entities: sentences, mentions, resolution, sentiment per mention and per page.

Everything after the first step is keyed by page. Pieces are dealt out by page once, and each
later grouping by (page, sentence) or (page, name) finds its rows where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import sentiment as S
from quillmill.functions import text as T
from quillmill.storage import materialize

#: How much more a title counts than the text, and an entity than a mere candidate.
TITLE_WEIGHT = ENTITY_WEIGHT = 2
MIN_SENTENCE, MIN_HIGHLIGHT = 3, 2
#: So many known names that hold a word of the lexicon are tested in the row; they stand in the plan, so there is a bound.
LOADED_NAMES = 1000


def sentence_table(pages: DataFrame) -> DataFrame:
    """page_key, site, sentence_idx, sentence, is_title of pages (page_key, site, title, text array).

    Pieces of text are joined by " . "; sentences of under three characters go; the title comes
    last, as one sentence, whatever its length. A page without text has its title alone.
    """
    row = lambda i, s, title: F.struct(i.cast("int").alias("sentence_idx"), s.alias("sentence"), F.lit(title).alias("is_title"))

    def rows(s: Column) -> Column:
        body = F.filter(F.transform(s, lambda x, i: row(i, x, False)), lambda r: F.length(r["sentence"]) >= MIN_SENTENCE)
        title = F.when(F.col("title").isNotNull(), F.array(row(F.size(s), F.col("title"), True)))
        return F.concat(body, F.coalesce(title, F.filter(body, lambda r: F.lit(False))))

    # as the one element of an array the sentences are worked out once, however often rows() names them
    cut = pages.select("page_key", "site", F.transform(F.array(T.sentences(F.array_join("text", " . "))), rows)[0].alias("_r"))
    # an outer generator has no inferred filter, which would split every text again
    return cut.select("page_key", "site", F.inline_outer("_r")).filter("sentence_idx IS NOT NULL")


def _cut(sentences: DataFrame, lexicon: dict[str, int], rows: Callable[[Column, Column], Column]) -> DataFrame:
    """The sentences' keys with the rows (structs) that rows() makes of a sentence's candidates and of the words of the lexicon outside of them."""
    terms = [t for t, s in lexicon.items() if s]
    named = lambda ts: F.filter(ts, lambda t: T.is_capital(t) & (F.length(t) >= 2))

    def made(ts: Column) -> Column:
        rest = F.filter(ts, lambda t: t.isin(terms))
        if any(len(t) == 1 for t in terms):  # a candidate of one letter is no name, but may be such a word
            rest = F.concat(rest, S.hits(F.array_join(F.filter(ts, lambda t: T.is_capital(t) & (F.length(t) < 2)), "\n"), lexicon))
        return F.transform(F.array(rest), lambda r: F.transform(F.array(named(ts)), lambda names: rows(names, r))[0])[0]

    cut = sentences.select("page_key", "site", "sentence_idx", "is_title", F.transform(F.array(T.tokens(F.col("sentence"))), made)[0].alias("_r"))
    return cut.select("page_key", "site", "sentence_idx", "is_title", F.inline_outer("_r"))


def piece_table(sentences: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """A row for each candidate of a sentence, and one for the rest of it, with the sum and number of lexicon hits.

    The rest has no piece: nothing but its hits is asked of it later, so its text isn't carried on.
    """
    none = F.array().cast("array<string>")
    row = lambda i, x, hits: F.struct(i.cast("int").alias("piece_idx"), x.alias("piece"), hits.alias("_rest"))
    rows = lambda names, rest: F.concat(F.array(row(F.lit(-1), F.lit(None).cast("string"), rest)), F.transform(names, lambda x, i: row(i, x, none)))
    found = _cut(sentences, lexicon, rows).withColumn("_hits", F.when(F.col("piece").isNull(), F.col("_rest")).otherwise(S.hits(F.col("piece"), lexicon)))
    total, count = S.hit_totals(F.col("_hits"), lexicon)
    return found.select("page_key", "site", "sentence_idx", "is_title", "piece_idx", "piece", F.col("piece").isNotNull().alias("is_candidate"), total.alias("hit_sum"), count.alias("hit_count"))


def candidate_table(sentences: DataFrame, lexicon: dict[str, int]) -> DataFrame:
    """The candidates of piece_table() alone, each with the hits of its sentence's rest as rest_sum and rest_count.

    That is half the rows. A sentence without a candidate has none.
    """
    rows = lambda names, rest: F.transform(names, lambda x: F.struct(x.alias("piece"), rest.alias("_rest")))
    found = _cut(sentences, lexicon, rows).filter("piece IS NOT NULL").withColumn("_hits", S.hits(F.col("piece"), lexicon))
    own, rest = S.hit_totals(F.col("_hits"), lexicon), S.hit_totals(F.col("_rest"), lexicon)
    return found.select("page_key", "site", "sentence_idx", "is_title", "piece", F.lit(True).alias("is_candidate"), own[0].alias("hit_sum"), own[1].alias("hit_count"), rest[0].alias("rest_sum"), rest[1].alias("rest_count"))


def one_per_name(gazetteer: DataFrame) -> DataFrame:
    """A row for each lower-cased name: of several categories, the first."""
    best = gazetteer.groupBy("_name").agg(F.min_by(F.struct("name", "category", "disabled"), F.struct("category", "name")).alias("_g"))
    return best.select("_name", F.col("_g.name").alias("name"), F.col("_g.category").alias("category"), F.coalesce("_g.disabled", F.lit(False)).alias("disabled"))


def resolve(pieces: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Adds name, category and is_entity. Names the gazetteer lacks, or has disabled, stay candidates.

    Its known names are stored first, so that Catalyst knows their size and broadcasts them if they are
    small, before any piece is dealt out; otherwise both sides are dealt by name and AQE splits names
    that are too common. Rows that are no candidates get a key that no name
    has, by their sentence, so that they are spread instead of meeting at null.
    """
    return _resolved(pieces, known_names(gazetteer))


def known_names(gazetteer: DataFrame) -> DataFrame:
    """_name, name and category of the names that aren't disabled, stored."""
    return materialize(one_per_name(gazetteer).filter(~F.col("disabled")).drop("disabled"), "known-names")


def _resolved(pieces: DataFrame, known: DataFrame) -> DataFrame:
    spread = F.concat(F.lit(T.MARK), F.xxhash64("page_key", "sentence_idx").cast("string"))
    keyed = pieces.withColumn("_name", F.when(F.col("is_candidate"), F.lower("piece")).otherwise(spread))
    joined = keyed.join(known, "_name", "left")
    entity = F.col("name").isNotNull()
    return joined.select(*pieces.columns, F.when(entity, F.col("name")).alias("name"), F.when(entity, F.col("category")).alias("category"), entity.alias("is_entity"))


def sentence_scores(resolved: DataFrame) -> DataFrame:
    """page_key, sentence_idx, score (in full): the sentiment of the sentence without its entities; candidates stay in."""
    own = F.when(~F.col("is_entity"), F.col("hit_sum")), F.when(~F.col("is_entity"), F.col("hit_count"))
    sums = resolved.groupBy("page_key", "sentence_idx").agg(F.sum(own[0]).alias("t"), F.sum(own[1]).alias("n"))
    return sums.select("page_key", "sentence_idx", S.score_of(F.coalesce("t", F.lit(0)), F.coalesce("n", F.lit(0)), None).alias("score"))


def with_sentence_score(resolved: DataFrame) -> DataFrame:
    """The pieces with their sentence's sentiment, as score: what sentence_scores() gives, found in one pass by a window over each sentence instead of a join with itself.

    Pieces are all of a sentence, or those of candidate_table().
    """
    resolved = resolved.repartition("page_key")  # serves this window and every later grouping by page
    here = Window.partitionBy("page_key", "sentence_idx")
    rest = ["rest_sum", "rest_count"] if "rest_sum" in resolved.columns else []
    own = lambda c, r: F.coalesce(F.sum(F.when(~F.col("is_entity"), F.col(c))).over(here), F.lit(0)) + (F.col(r) if rest else F.lit(0))
    summed = resolved.withColumn("_t", own("hit_sum", "rest_sum")).withColumn("_n", own("hit_count", "rest_count"))
    return summed.withColumn("score", S.score_of(F.col("_t"), F.col("_n"), None)).drop("_t", "_n", *rest)


def highlight_mentions(sentences: DataFrame, highlights: DataFrame, gazetteer: DataFrame, double_count: bool = True) -> DataFrame:
    """Mentions of highlighted strings (page_key, highlight) inside the page's sentences, in the form of mentions().

    A highlight that is one of the sentence's candidates is not counted again; a known entity
    is, unless double_count is off. The join is on the page, and few strings are highlighted on one.
    """
    marks = highlights.filter(F.length("highlight") >= MIN_HIGHLIGHT).distinct()
    pairs = sentences.filter(~F.col("is_title")).join(marks, "page_key").filter(F.contains("sentence", "highlight"))
    pairs = pairs.withColumn("_seen", F.array_contains(T.candidates(F.col("sentence")), F.col("highlight"))).withColumn("_name", F.lower("highlight"))
    known = one_per_name(gazetteer).filter(~F.col("disabled"))
    joined = pairs.join(known, "_name", "left").withColumn("is_entity", F.col("name").isNotNull())
    new = ~F.col("_seen") | (F.col("is_entity") & F.lit(double_count))
    return joined.filter(new).select("page_key", "site", "sentence_idx", "is_title", F.col("highlight").alias("surface"), "name", "category", "is_entity")


def mentions(resolved: DataFrame) -> DataFrame:
    """A row for each candidate or entity in a sentence: page_key, site, sentence_idx, is_title, surface, name, category, is_entity, and score if it is there."""
    score = ["score"] if "score" in resolved.columns else []
    return resolved.filter("is_candidate").select("page_key", "site", "sentence_idx", "is_title", F.col("piece").alias("surface"), "name", "category", "is_entity", *score)


def scored_mentions(found: DataFrame, scores: DataFrame) -> DataFrame:
    return found.join(scores, ["page_key", "sentence_idx"])


def scored_candidates(sentences: DataFrame, lexicon: dict[str, int], gazetteer: DataFrame, most: int = LOADED_NAMES) -> DataFrame:
    """mentions() of the sentences' candidates with their sentence's sentiment as score: the same as by with_sentence_score(), mostly without a row meeting another of its sentence.

    Of a sentence's candidates only those with a word of the lexicon bear on its sentiment, and of those the gazetteer
    knows few. With up to `most` such names the sentiment is found where the sentence is cut; with more, by the window.
    """
    known = known_names(gazetteer)
    loaded = [r[0] for r in known.filter(S.has_hit(F.col("_name"), lexicon)).select("_name").limit(most + 1).collect()]
    if len(loaded) > most:
        return mentions(with_sentence_score(_resolved(candidate_table(sentences, lexicon), known)))
    none = F.array().cast("array<string>")

    def own(names: Column) -> Column:
        """Hits of the candidates that are no entities, a line apart, so that words of two names don't meet."""
        free = F.filter(names, lambda n: ~F.lower(n).isin(loaded))
        return F.when(S.has_hit(F.array_join(names, "\n"), lexicon), S.hits(F.array_join(free, "\n"), lexicon)).otherwise(none)

    rows = lambda names, rest: F.transform(F.array(F.concat(rest, own(names))), lambda hits: F.transform(names, lambda x: F.struct(x.alias("piece"), hits.alias("_hits"))))[0]
    total, count = S.hit_totals(F.col("_hits"), lexicon)
    found = _cut(sentences, lexicon, rows).filter("piece IS NOT NULL").withColumn("score", S.score_of(total, count, None)).withColumn("is_candidate", F.lit(True))
    return mentions(_resolved(found.select("page_key", "site", "sentence_idx", "is_title", "piece", "is_candidate", "score"), known))


def page_entities(scored: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """page_key, site, name, category, count, score, type: mentions and their mean sentiment.

    keywords (page_key, site, name, category), the known ones of a page's meta tags, count as
    mentions of sentiment 0.
    """
    rows = scored.filter("is_entity").select("page_key", "site", "name", "category", "score")
    if keywords is not None:
        rows = rows.unionByName(keywords.select("page_key", "site", "name", "category", F.lit(0.0).alias("score")))
    out = rows.groupBy("page_key", "site", "name", "category").agg(F.count("*").alias("count"), F.round(F.avg("score"), S.DIGITS).alias("score"))
    return out.withColumn("type", S.kind_of(F.col("score")))


def page_candidates(scored: DataFrame, mode: str = "last") -> DataFrame:
    """page_key, site, name, count, score, type of names that aren't known entities.

    mode "last": the last sentence's sentiment, count 1. mode "mean": mentions and their mean.
    """
    rows = scored.filter(~F.col("is_entity")).groupBy("page_key", "site", F.col("surface").alias("name"))
    if mode == "last":
        out = rows.agg(F.lit(1).cast("long").alias("count"), F.round(F.max_by("score", "sentence_idx"), S.DIGITS).alias("score"))
    elif mode == "mean":
        out = rows.agg(F.count("*").alias("count"), F.round(F.avg("score"), S.DIGITS).alias("score"))
    else:
        raise ValueError(f"mode is last or mean, not {mode}")
    return out.withColumn("type", S.kind_of(F.col("score")))


def weights(found: DataFrame) -> DataFrame:
    """page_key, name, weight: how often a name occurs, a title and an entity counting twice, an entity in a title four times."""
    weight = F.when(F.col("is_title"), TITLE_WEIGHT).otherwise(1) * F.when(F.col("is_entity"), ENTITY_WEIGHT).otherwise(1)
    return found.groupBy("page_key", F.coalesce("name", "surface").alias("name")).agg(F.sum(weight.cast("long")).alias("weight"))


def suggested(found: DataFrame) -> DataFrame:
    """page_key and suggested, the page's names by weight, then by name."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "name")))
    return weights(found).groupBy("page_key").agg(F.transform(order, lambda x: x["name"]).alias("suggested"))


def keyword_entities(pages: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The known entities among the pages' keywords (an array column), each once for a page and name."""
    words = pages.select("page_key", "site", F.explode("keywords").alias("k")).withColumn("_name", F.lower("k"))
    return words.join(one_per_name(gazetteer).filter(~F.col("disabled")), "_name").select("page_key", "site", "name", "category").distinct()


def extract(pages: DataFrame, gazetteer: DataFrame, lexicon: dict[str, int], mode: str = "last") -> tuple[DataFrame, DataFrame]:
    """Extracted pages, one row each, and rejects (page_key, reason: pages without text).

    Pages have page_key, site, title, text (array), and may have highlighted_strings and
    keywords (arrays).
    """
    good = pages.filter(F.size("text") > 0)
    rejects = pages.filter((F.size("text") <= 0) | F.col("text").isNull()).select("page_key", F.lit("no text").alias("reason"))
    sents = sentence_table(good)
    # mentions are read three times: each would cut and resolve all texts again
    if "highlighted_strings" not in pages.columns:
        scored = found = materialize(scored_candidates(sents, lexicon, gazetteer), "mentions")
    else:
        resolved = materialize(resolve(piece_table(sents, lexicon), gazetteer), "pieces")  # read twice
        found = materialize(mentions(with_sentence_score(resolved)), "mentions")
        marks = good.select("page_key", F.explode("highlighted_strings").alias("highlight"))
        scored = found.unionByName(scored_mentions(highlight_mentions(sents, marks, gazetteer), sentence_scores(resolved)), allowMissingColumns=True)
    keywords = keyword_entities(good, gazetteer) if "keywords" in pages.columns else None
    nested = lambda df, *names: df.groupBy("page_key").agg(F.sort_array(F.collect_list(F.struct(*names, F.struct("score", "count", "type").alias("sentiment")))).alias("_x"))
    ents = nested(page_entities(scored, keywords), "name", "category").withColumnRenamed("_x", "entities")
    cands = nested(page_candidates(scored, mode), "name").withColumnRenamed("_x", "candidates")
    out = good.join(ents, "page_key", "left").join(cands, "page_key", "left").join(suggested(found).withColumnRenamed("suggested", "suggested_entities"), "page_key", "left")
    return out, rejects


def occurrences(found: DataFrame) -> DataFrame:
    """_name and occur: how often each name was looked up, found or disabled or not."""
    return found.groupBy(F.lower("surface").alias("_name")).agg(F.count("*").alias("occur"))


def mention_key(name: Column, category: Column) -> Column:
    return F.concat_ws(".", name, category)


def ranked(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """df with rank, 1 for the first of each key in the order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
