"""Phrase search over transcripts of any length by a positional index, and over a whole corpus by anchors.

A phrase is cut at its spaces.  Where it has several parts, a hit is a token
that ends with the first part, tokens equal to the inner ones, and a token that begins
with the last; a phrase of one part may stand anywhere inside a token.  So a
part is first matched against the distinct tokens of a medium.  The part with
the fewest places is looked up in the index, and the tokens around each place
are checked by their positions.  No row holds a medium.

After a hit the next one starts at least as many characters on as the phrase
has words.  Hits that are closer overlap by more than half, and then follow each other
by the phrase's own period; so which of them count follows from their number
in such a chain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .match import words

#: Chains of hits are numbered within blocks of so many characters.
CHAIN = 1 << 20
#: Phrases whose anchors are put into the plan; with more, anchors are a table that is joined.
MOST_ANCHORS = 10_000
#: Neighbouring sentences that meet the phrases of their medium together.
LINES = 64


def positions(tokens: DataFrame) -> DataFrame:
    """media_id, pos, at, token, start_ms, end_ms: tokens numbered through their medium, and the characters ahead of each.

    Summed over sentences, a narrow row each, and then within a sentence.
    """
    size = F.length("token") + 1
    earlier = Window.partitionBy("media_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, -1)
    sums = tokens.groupBy("media_id", "sent_idx").agg(F.count("*").alias("n"), F.sum(size).alias("chars"))
    sums = sums.select("media_id", "sent_idx", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "chars")))
    own = Window.partitionBy("media_id", "sent_idx").orderBy("tok_idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumns({"n_own": F.count("*").over(own), "chars_own": F.coalesce(F.sum(size).over(own), F.lit(0))}).join(sums, ["media_id", "sent_idx"])
    return rows.select("media_id", (F.col("n_before") + F.col("n_own")).alias("pos"), (F.col("chars_before") + F.col("chars_own")).alias("at"), "token", "start_ms", "end_ms")


def _fits(token: Column, part: Column, place: Column, last: Column) -> Column:
    """Whether a token can stand at part ``place`` of a phrase whose last part is ``last``."""
    return F.when(last == 0, F.contains(token, part)).when(place == 0, F.endswith(token, part)).when(place == last, F.startswith(token, part)).otherwise(token == part)


def phrase_places(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """``pieces`` with pos, inner, at of the hits that count in the piece's own medium: token, character in the token, character in the medium."""
    repeats = _period(F.col("phrase")).isNotNull()
    # Phrases that can overlap themselves closely are few; mostly there is none.
    if pieces.where(repeats).isEmpty():
        return _places(pieces, index)
    return _places(pieces.where(~repeats), index).unionByName(_spaced(_places(pieces.where(repeats), index)))


def _places(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """Every place of each phrase in its medium."""
    asked = pieces.withColumn("parts_", F.split("phrase", " ", -1)).withColumn("last_", F.size("parts_") - 1).withColumn("key_", F.xxhash64("media_id", "phrase"))
    keyed = asked.select("key_", "media_id", "phrase", "parts_", "last_").dropDuplicates(["media_id", "phrase"])
    # A space at an end asks for a token there, whichever it is: that is seen when positions are checked.
    open_ = (F.col("last_") > 0) & (F.col("part_") == "") & F.col("place_").isin(F.lit(0), F.col("last_"))
    parts = keyed.select("key_", "media_id", "phrase", "last_", F.posexplode("parts_").alias("place_", "part_")).where(~open_)
    asks = parts.groupBy("key_", "media_id", "phrase").agg(F.count("*").alias("asked_"))
    vocabulary = index.groupBy("media_id", "token").agg(F.count("*").alias("places_"))
    known = vocabulary.join(parts, "media_id").where(_fits(F.col("token"), F.col("part_"), F.col("place_"), F.col("last_")))
    # The part with the fewest places is the anchor; a part without any leaves no hit.
    totals = known.groupBy("key_", "media_id", "phrase", "last_", "place_").agg(F.sum("places_").alias("n_"))
    best = totals.groupBy("key_", "media_id", "phrase", "last_").agg(F.min(F.struct("n_", "place_")).alias("best_"), F.count("*").alias("matched_"))
    best = best.join(asks, ["key_", "media_id", "phrase"]).where("matched_ = asked_")
    anchor = known.join(best.select("key_", "media_id", "phrase", F.col("best_.place_").alias("place_")), ["key_", "media_id", "phrase", "place_"])
    found = index.select("media_id", "token", "pos", "at").join(anchor.select("media_id", "token", "phrase", "last_", "place_"), ["media_id", "token"])
    found = found.withColumn("pos", F.col("pos") - F.col("place_")).where("pos >= 0")
    place = index.select("media_id", "pos", "token", "at")
    # One part: the token is known already.  More: every part is checked at its own position.
    split = F.split("phrase", " ", -1)
    check = found.where("last_ > 0").select("media_id", "phrase", "last_", "pos").withColumn("place_", F.explode(F.sequence(F.lit(0), F.col("last_")))).withColumn("first_", F.col("pos")).withColumn("pos", F.col("pos") + F.col("place_"))
    check = check.join(place, ["media_id", "pos"]).where(_fits(F.col("token"), F.get(split, F.col("place_")), F.col("place_"), F.col("last_")))
    start = F.when(F.col("place_") == 0, F.struct((F.length("token") - F.length(F.get(split, F.lit(0)))).alias("inner"), F.col("at")))
    several = check.groupBy("media_id", "phrase", "last_", F.col("first_").alias("pos")).agg(F.count("*").alias("n_"), F.max(start).alias("start_")).where("n_ = last_ + 1")
    several = several.select("media_id", "phrase", "pos", F.col("start_.inner").alias("inner"), (F.col("start_.at") + F.col("start_.inner")).alias("at"))
    inside = F.filter(F.sequence(F.lit(0), F.length("token") - F.length("phrase")), lambda k: F.substring("token", k + 1, F.length("phrase")) == F.col("phrase"))
    single = found.where("last_ = 0").withColumn("inner", F.explode(inside))
    single = single.select("media_id", "phrase", "pos", "inner", (F.col("at") + F.col("inner")).alias("at"))
    return pieces.join(several.unionByName(single), ["media_id", "phrase"]).select(*pieces.columns, "pos", "inner", "at")


def _period(phrase: Column) -> Column:
    """The smallest shift, below its number of words, at which a phrase overlaps itself; null where there is none."""
    n = words(phrase)
    shifts = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda p: (p < n) & F.startswith(phrase, F.substring(phrase, p + 1, F.length(phrase))))
    return F.try_element_at(shifts, F.lit(1))


def _spaced(hits: DataFrame) -> DataFrame:
    """The hits that count: of a chain, each period apart, every so many-th one."""
    given = hits if "period_" in hits.columns else hits.withColumns({"period_": _period(F.col("phrase")), "words_": words(F.col("phrase"))})
    chained = given.withColumn("block_", F.floor(F.col("at") / CHAIN))
    # The start of a hit's chain, in two levels: within blocks, and from block to block.
    key = ["request_id", "piece_idx"]
    near, blocks = Window.partitionBy(*key, "block_").orderBy("at"), Window.partitionBy(*key).orderBy("block_")
    ends = chained.groupBy(*key, "block_").agg(F.max("at").alias("end_"))
    ends = ends.select(*key, "block_", F.lag("end_").over(blocks).alias("before_"))
    chained = chained.join(ends, [*key, "block_"])
    gap = F.col("at") - F.coalesce(F.lag("at").over(near), F.col("before_"))
    chained = chained.withColumn("fresh_", F.when(F.coalesce(gap != F.col("period_"), F.lit(True)), F.col("at")))
    starts = chained.groupBy(*key, "block_").agg(F.max("fresh_").alias("start_"))
    starts = starts.select(*key, "block_", F.last("start_", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("carry_"))
    upto = near.rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.withColumn("own_", F.last("fresh_", ignorenulls=True).over(upto)).join(starts, [*key, "block_"])
    number = (F.col("at") - F.coalesce("own_", "carry_")) / F.col("period_")
    return chained.where(F.pmod(number.cast("long"), F.ceil(F.col("words_") / F.col("period_"))) == 0).select(hits.columns)


def _timed(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """``pieces`` with pos, inner, start_ms, end_ms of each hit; times are null where the medium has no such token."""
    found = phrase_places(pieces, index).withColumn("pos_end_", F.col("pos") + words(F.col("phrase")) - 1)
    found = found.join(index.select("media_id", "pos", "start_ms"), ["media_id", "pos"], "left")
    found = found.join(index.select("media_id", F.col("pos").alias("pos_end_"), "end_ms"), ["media_id", "pos_end_"], "left")
    return found.select(*pieces.columns, "pos", "inner", "start_ms", "end_ms")


def phrase_match(pieces: DataFrame, index: DataFrame) -> DataFrame:
    """``pieces`` (request_id, piece_idx, media_id, phrase, ...) with occurrence, start_ms, end_ms: a row for each hit in the piece's own medium."""
    order = Window.partitionBy("request_id", "piece_idx").orderBy("pos", "inner")
    rows = _timed(pieces, index).withColumn("occurrence", F.row_number().over(order) - 1)
    return rows.where("start_ms is not null and end_ms is not null").select(*pieces.columns, "occurrence", "start_ms", "end_ms")


def _line_block() -> Column:
    return F.call_function("div", F.col("sent_idx"), F.lit(LINES))


def sentence_hits(pieces: DataFrame, sentences: DataFrame, first: bool = False) -> DataFrame:
    """The hits of ``pieces`` (request_id, media_id, piece_idx, phrase, ...) in ``sentences`` as ``placed_sentences`` gives them, whole ones and those that a sentence cuts.

    Phrases meet the sentences of their medium, LINES neighbouring ones in a
    row's reach, and are looked for inside the array of a sentence's tokens.  Of a hit that
    runs on into later sentences ``rest_`` holds the parts that are still to be checked.
    Rows: the other columns of ``pieces`` with pos, at, inner, start_ms, end_ms and what ``whole_hits`` needs.

    ``first``: where it is only asked whether a piece has a hit, a sentence gives its first one and those that
    run on, unless that one has no time or the phrase can overlap itself closely.
    """
    asked = pieces.withColumns({"parts_": F.split("phrase", " ", -1), "words_": words(F.col("phrase")), "period_": _period(F.col("phrase"))}).withColumn("last_", F.size("parts_") - 1)
    asked = asked.join(sentences.select("media_id", _line_block().alias("block_")).distinct(), "media_id")
    lines = sentences.where("size(tokens) > 0").select("media_id", _line_block().alias("block_"), "tokens", "places", F.col("timestamp.start_ms").alias("starts_"), F.col("timestamp.end_ms").alias("ends_"), "n_before", "chars_before", F.array_join("tokens", " ").alias("raw_"))
    met = lines.join(asked, ["media_id", "block_"]).withColumn("in_", F.contains("raw_", "phrase")).where("in_ or last_ > 0")
    n, last, parts = F.size("tokens"), F.col("last_"), F.col("parts_")

    def begins(i: Column) -> Column:
        later = lambda j: _fits(F.get("tokens", i + j), F.get(parts, j), j, last)
        return F.endswith(F.get("tokens", i), F.get(parts, F.lit(0))) & ((i == n - 1) | F.forall(F.sequence(F.lit(1), F.least(last, F.greatest(n - 1 - i, F.lit(1)))), later))

    def inners(token: Column) -> Column:
        size, at = F.length("phrase"), lambda k: F.call_function("locate", F.col("phrase"), token, k)
        every = F.filter(F.sequence(F.lit(0), F.length(token) - size), lambda k: F.substring(token, k + 1, size) == F.col("phrase"))
        single = F.when(at(at(F.lit(1)) + 1) == 0, F.array(at(F.lit(1)) - 1)).otherwise(every)
        return F.when(last == 0, single).otherwise(F.array(F.length(token) - F.length(F.get(parts, F.lit(0)))))

    def hit(i: Column, inner: Column) -> Column:
        rest = F.when(i + last >= n, F.slice(parts, n - i + 1, F.greatest(i + last + 1 - n, F.lit(0))))
        return F.struct(
            (F.col("n_before") + i).alias("pos"), (F.col("chars_before") + F.get("places", i) + inner).alias("at"), inner.alias("inner"),
            F.get("starts_", i).alias("start_ms"), F.get("ends_", i + F.col("words_") - 1).alias("end_ms"), rest.alias("rest_"), (n - i).alias("had_"),
        )

    # A phrase that is not in the sentence can only begin in its last tokens.
    low = F.when(F.col("in_"), F.lit(0)).otherwise(F.greatest(n - last, F.lit(0)))
    holds = F.transform("tokens", lambda t, i: F.when(F.contains(t, F.col("phrase")), i))
    found = F.when(last == 0, F.array_compact(holds)).otherwise(F.filter(F.sequence(low, n - 1), begins))
    if first:
        timed = lambda i: F.get("starts_", i).isNotNull() & F.get("ends_", i + F.col("words_") - 1).isNotNull()
        # A list of one list, so that the tokens are looked through once.
        found = F.flatten(F.transform(F.array(found), lambda f: F.filter(f, lambda i, k: (k == 0) | (i + last >= n) | F.col("period_").isNotNull() | ~timed(F.get(f, F.lit(0))))))
    hits = F.flatten(F.transform(found, lambda i: F.transform(inners(F.get("tokens", i)), lambda k: hit(i, k))))
    kept = [c for c in pieces.columns if c != "phrase"]
    return met.select(*kept, "words_", "period_", "last_", F.explode(hits).alias("h")).select(*kept, "words_", "period_", "last_", "h.*")


def whole_hits(hits: DataFrame, sentences: DataFrame) -> DataFrame:
    """What ``sentence_hits`` has given, best as a stored table, with the cut hits checked to their end and only those that count."""
    cut = hits.where("rest_ is not null")
    # Only tokens near the beginning of a sentence can end a hit that was cut before it.
    most = cut.groupBy("media_id").agg(F.max(F.size("rest_")).alias("most_")).join(sentences.select("media_id", _line_block().alias("block_")).distinct(), "media_id")
    first = sentences.withColumn("block_", _line_block()).join(most, ["media_id", "block_"])
    first = first.select("media_id", "n_before", F.col("timestamp.end_ms").alias("ends_"), F.posexplode(F.slice("tokens", F.lit(1), F.col("most_"))).alias("k", "token"))
    first = first.select("media_id", (F.col("n_before") + F.col("k")).alias("place_"), "token", F.get("ends_", F.col("k")).alias("token_end_"))
    asks = cut.select("media_id", "request_id", "piece_idx", "pos", "last_", "words_", F.size("rest_").alias("asked_"), "had_", F.posexplode("rest_").alias("k", "part_"))
    asks = asks.withColumn("k", F.col("k") + F.col("had_")).withColumn("place_", F.col("pos") + F.col("k"))
    good = asks.join(first, ["media_id", "place_"]).where(_fits(F.col("token"), F.col("part_"), F.col("k"), F.col("last_")))
    good = good.groupBy("request_id", "piece_idx", "pos", "asked_").agg(F.count_distinct("k").alias("n_"), F.max(F.when(F.col("k") == F.col("words_") - 1, F.col("token_end_"))).alias("later_")).where("n_ = asked_")
    checked = cut.join(good.select("request_id", "piece_idx", "pos", "later_"), ["request_id", "piece_idx", "pos"]).withColumn("end_ms", F.coalesce("end_ms", "later_"))
    every = hits.where("rest_ is null").unionByName(checked.select(hits.columns))
    # Phrases that can overlap themselves closely are few; mostly there is none.
    if not hits.where("period_ is not null").isEmpty():
        every = every.where("period_ is null").unionByName(_spaced(every.where("period_ is not null")))
    return every.drop("words_", "period_", "last_", "rest_", "had_")


def corpus_phrases(docs: DataFrame, phrases: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """item_id, doc_id, tok_idx: where phrases of any length stand in any text, also inside words at their ends.

    ``docs``: doc_id, text; ``phrases``: item_id, phrase.  Texts and phrases are
    runs of tokens with one space between.  A phrase of four tokens or more is
    anchored on two neighbouring inner ones, of all such pairs the one that
    fewest phrases hold, the longest of those; texts are searched for all anchors at once, inside the
    array of their tokens, and only places of an anchor become rows.  Shorter
    phrases are looked for token by token.  ``most`` phrases go into the plan as
    they are; the anchors of more than that are a table that pairs of tokens are joined with.
    """
    asked = phrases.select("item_id", tokenize(F.col("phrase")).alias("p")).where("size(p) > 0")
    pair = lambda t, i: F.concat(F.get(t, i), F.lit(" "), F.get(t, i + 1))
    long = asked.where("size(p) >= 4").select("item_id", "p", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p") - 3), lambda i: pair(F.col("p"), i))).alias("k", "pair"))
    common = long.groupBy("pair").agg(F.countDistinct("item_id").alias("n"))
    chosen = long.join(common, "pair").groupBy("item_id", "p").agg(F.min(F.struct("n", (-F.length("pair")).alias("size"), "k", "pair")).alias("a"))
    chosen = chosen.select("item_id", "p", (F.col("a.k") + 1).alias("offset"), F.col("a.pair").alias("pair"))
    few = chosen.limit(most + 1).count() <= most
    texts = docs.select("doc_id", tokenize(F.col("text")).alias("t"))
    every = F.sequence(F.lit(0), F.size("t") - 2)
    if few:
        known = [r.pair for r in chosen.select("pair").distinct().collect()]  # at most ``most``
        at = F.filter(every, lambda i: pair(F.col("t"), i).isin(known)) if known else F.array().cast("array<int>")
        places = texts.where("size(t) >= 4").withColumn("i", F.explode(at)).withColumn("pair", pair(F.col("t"), F.col("i"))).join(F.broadcast(chosen), "pair")
    else:
        rows = texts.where("size(t) >= 4").select("doc_id", F.posexplode(F.transform(every, lambda i: pair(F.col("t"), i))).alias("i", "pair"))
        places = rows.join(chosen, "pair").join(texts, "doc_id")
    first = F.col("i") - F.col("offset")
    found = _verified(places.withColumn("first", first))
    short = asked.where("size(p) < 4")
    if short.isEmpty():
        return found
    # First tokens of short phrases: any token that ends with one, or holds a phrase of one token.
    heads = [r for r in short.limit(most + 1).select(F.get("p", F.lit(0)).alias("head"), (F.size("p") == 1).alias("alone")).distinct().collect()]
    if len(heads) > most:
        raise ValueError(f"more than {most} phrases of one to three tokens")
    form = "|".join(sorted(re.escape(r.head) + ("" if r.alone else r"\z") for r in heads))
    at = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.get("t", i).rlike(form))
    few_rows = texts.where("size(t) > 0").withColumn("first", F.explode(at))
    single = F.col("token").contains(F.get("p", F.lit(0)))
    met = few_rows.withColumn("token", F.get("t", F.col("first"))).join(F.broadcast(short), F.when(F.size("p") == 1, single).otherwise(F.endswith(F.col("token"), F.get("p", F.lit(0)))))
    alone = met.where("size(p) = 1")
    size = F.length(F.get("p", F.lit(0)))
    times = F.size(F.filter(F.sequence(F.lit(0), F.length("token") - size), lambda k: F.substring("token", k + 1, size) == F.get("p", F.lit(0))))
    alone = alone.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select("item_id", "doc_id", F.col("first").alias("tok_idx"))
    return found.unionByName(alone).unionByName(_verified(met.where("size(p) > 1")))


def _verified(places: DataFrame) -> DataFrame:
    """The places (doc_id, t, item_id, p, first) where the tokens from ``first`` on are the phrase: equal inside, ending and beginning with its ends."""
    n = F.size("p")
    inner = F.slice("t", F.col("first") + 2, F.greatest(n - 2, F.lit(0))) == F.slice("p", F.lit(2), F.greatest(n - 2, F.lit(0)))
    ends = F.endswith(F.get("t", F.col("first")), F.get("p", F.lit(0))) & F.startswith(F.get("t", F.col("first") + n - 1), F.get("p", n - 1))
    inside = (F.col("first") >= 0) & (F.col("first") + n <= F.size("t"))
    return places.where(inside).where(ends & inner).select("item_id", "doc_id", F.col("first").cast("int").alias("tok_idx"))
