"""Clip requests and the time periods that they mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, normalize_phrase, tokenize
from ..functions.timecode import parse_time
from .running import numbered

MIN_SPEAKER_MS = 999
# How offsets and time ranges are written.
_PAIR = r"\[(\d+),\s*(\d+)\]"
_CLOCK = r"\d{2}:\d{2}:\d{2},\d{2,3}"
_RANGE = rf"\[({_CLOCK})\s*-\s*({_CLOCK})\]"


def request_pieces(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """request_id, media_id, piece_idx, phrase, offset_b, offset_e, bracket_failed, bracket_matched: the parts between "#" with text, and the columns of requests to ``keep``."""
    piece = requests.where("dest_text is not null").select("request_id", "media_id", *keep, F.posexplode(F.split("dest_text", "#")).alias("piece_idx", "piece"))
    offset = lambda i: F.coalesce(F.regexp_extract("piece", _PAIR, i).try_cast("int"), F.lit(0))
    failed = F.contains("piece", F.lit("[")) & ~F.col("piece").rlike(_PAIR)
    phrase = normalize_phrase(F.element_at(F.split("piece", r"\["), 1))
    out = piece.select("request_id", "media_id", *keep, "piece_idx", phrase.alias("phrase"), offset(1).alias("offset_b"), offset(2).alias("offset_e"), failed.alias("bracket_failed"), F.col("piece").rlike(_PAIR).alias("bracket_matched"))
    return out.where(filled(F.col("phrase")))


def request_mode(requests: DataFrame, media: DataFrame) -> DataFrame:
    """Requests with ``mode``: given ranges, else speakers if named and known, else phrases.

    Requests on media that are not known, or hold no token, stay, with null
    for what is known of media: they find nothing, and the log says so.
    """
    known = requests.join(media.select("media_id", "modality", "has_spk", "n_ms"), "media_id", "left")
    named = F.coalesce(F.col("dest_spk") != "", F.lit(False))  # blanks are a name, which no speaker has
    mode = F.when(F.col("llm_response").isNotNull(), "ranges").when(named & F.coalesce("has_spk", F.lit(False)), "speaker").otherwise("phrase")
    return known.withColumn("mode", mode)


def words(phrase: Column) -> Column:
    """Number of words of a phrase: blanks at its ends and double ones make none."""
    return F.size(F.filter(F.split(phrase, r"\s+"), lambda x: x != ""))


def phrase_starts(raw: Column, phrase: Column) -> Column:
    """Tokens before each hit of a phrase, left to right.

    After a hit the next one starts at least as many characters on as the
    phrase has words.  The text is cut before every hit, also overlapping
    ones, and one pass over the pieces counts characters and spaces.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(raw, quoted, -1)
    gap = words(phrase)
    state = F.struct(F.lit(0).alias("c"), F.lit(0).alias("sp"), F.lit(0).alias("nx"), F.array().cast("array<int>").alias("hits"))

    def step(s: Column, piece: Column) -> Column:
        hit = ((s.c > 0) | F.startswith(raw, phrase)) & (s.c >= s.nx)
        spaces = F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))
        return F.struct(
            (s.c + F.length(piece)).alias("c"), (s.sp + spaces).alias("sp"), F.when(hit, s.c + gap).otherwise(s.nx).alias("nx"), F.when(hit, F.concat(s.hits, F.array(s.sp))).otherwise(s.hits).alias("hits")
        )

    return F.aggregate(pieces, state, step, lambda s: s.hits)


def _phrase_hits(pieces: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``pieces`` with occurrence, start_ms, end_ms of each hit, null where the transcript has no such token time."""
    met = transcripts.join(pieces, "media_id").where(F.contains("raw_text", "phrase"))
    hits = met.withColumn("at", phrase_starts(F.col("raw_text"), F.col("phrase"))).withColumn("n", words(F.col("phrase")))
    ends = F.transform("at", lambda i: F.struct(F.try_element_at("timestamp", i + 1).start_ms.alias("start_ms"), F.try_element_at("timestamp", i + F.col("n")).end_ms.alias("end_ms")))
    rows = hits.withColumn("times", ends).select(*pieces.columns, F.posexplode("times").alias("occurrence", "t"))
    return rows.select(*pieces.columns, "occurrence", "t.start_ms", "t.end_ms")


def phrase_match(pieces: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``pieces`` with occurrence, start_ms, end_ms: a row for each hit in the piece's own medium."""
    return _phrase_hits(pieces, transcripts).where("start_ms is not null and end_ms is not null")


def phrase_rejects(pieces: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``pieces`` with occurrence and reason: the hits that ``phrase_match`` leaves out."""
    lost = _phrase_hits(pieces, transcripts).where("start_ms is null or end_ms is null")
    return lost.select(*pieces.columns, "occurrence", F.lit("no time for a token of the hit").alias("reason"))


def corpus_search(docs: DataFrame, phrases: DataFrame, words: int) -> DataFrame:
    """item_id, doc_id, tok_idx: where each phrase of ``words`` tokens stands in any text.

    An equi join of the 64-bit hashes of runs of tokens, with their first and
    last tokens for a check: no run is written out, and no row carries a text.
    """
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("t")).where(F.size("t") >= words)
    place = lambda i: F.struct(F.xxhash64(F.slice("t", i, words)).alias("run"), F.element_at("t", i).alias("first"), F.element_at("t", i + (words - 1)).alias("last"))
    runs = tokens.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("t") - (words - 1)), place)).alias("tok_idx", "at")).select("doc_id", "tok_idx", "at.*")
    asked = phrases.withColumn("t", F.split("phrase", " ")).where(F.size("t") == words)
    asked = asked.select("item_id", F.xxhash64("t").alias("run"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
    return runs.join(asked, ["run", "first", "last"]).select("item_id", "doc_id", "tok_idx")


def speaker_match(requests: DataFrame, envelopes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """request_id, media_id, piece_idx, occurrence, start_ms, end_ms: sentences over 999 ms of the named speakers."""
    named = requests.select("request_id", "media_id", *keep, F.posexplode(F.split("dest_spk", "#")).alias("piece_idx", "name")).withColumn("who", F.substring("name", 4, 1 << 20))
    spoken = envelopes.where(F.col("spk").isNotNull() & (F.col("end_ms") - F.col("start_ms") > MIN_SPEAKER_MS)).withColumn("who", F.col("spk").cast("string"))
    return named.join(spoken, ["media_id", "who"]).select("request_id", "media_id", "piece_idx", F.col("sent_idx").alias("occurrence"), "start_ms", "end_ms", *keep)


def text_ranges(requests: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """request_id, media_id, occurrence, start_ms, end_ms: the time ranges in brackets in a response."""
    both = F.arrays_zip(*(F.regexp_extract_all("llm_response", F.lit(_RANGE), F.lit(i)).alias(n) for i, n in ((1, "a"), (2, "b"))))
    rows = requests.where("llm_response is not null").select("request_id", "media_id", *keep, F.posexplode(both).alias("occurrence", "r"))
    return rows.select("request_id", "media_id", "occurrence", parse_time(F.col("r.a")).alias("start_ms"), parse_time(F.col("r.b")).alias("end_ms"), *keep)


def envelopes(sentences: DataFrame) -> DataFrame:
    """media_id, sent_idx, spk, start_ms, end_ms of each sentence."""
    return sentences.select("media_id", "sent_idx", "spk", F.element_at("timestamp", 1).start_ms.alias("start_ms"), F.element_at("timestamp", -1).end_ms.alias("end_ms"))


def periods(moded: DataFrame, transcripts: DataFrame, sentences: DataFrame, matching: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """request_id, media_id, piece_idx, occurrence, start_ms, end_ms: each request's periods by its mode, duplicates kept.

    ``matching``: how pieces meet ``transcripts``; by default ``phrase_match``, a medium a row.
    """
    pieces = lower_for_video(request_pieces(moded.where("mode = 'phrase'")), moded.select("media_id", "modality").distinct())
    phrase = (matching or phrase_match)(pieces, transcripts)
    phrase = phrase.select("request_id", "media_id", "piece_idx", F.col("occurrence").cast("long"), (F.col("start_ms") + F.col("offset_b")).alias("start_ms"), (F.col("end_ms") + F.col("offset_e")).alias("end_ms"))
    speaker = speaker_match(moded.where("mode = 'speaker'"), envelopes(sentences))
    ranges = text_ranges(moded.where("mode = 'ranges'")).withColumn("piece_idx", F.lit(0)).withColumn("occurrence", F.col("occurrence").cast("long"))
    return phrase.unionByName(speaker).unionByName(ranges)


def placed_periods(moded: DataFrame, hits: DataFrame, sentences: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``periods`` with the columns of requests to ``keep``, which ``hits`` has too; ``occurrence`` of a hit is its place in the medium.

    ``hits``: the hits of phrases that ``phrase_index.whole_hits`` gives.
    """
    phrase = hits.where("start_ms is not null and end_ms is not null")
    phrase = phrase.select("request_id", "media_id", "piece_idx", F.col("at").alias("occurrence"), (F.col("start_ms") + F.col("offset_b")).alias("start_ms"), (F.col("end_ms") + F.col("offset_e")).alias("end_ms"), *keep)
    speaker = speaker_match(moded.where("mode = 'speaker'"), envelopes(sentences), keep)
    ranges = text_ranges(moded.where("mode = 'ranges'"), keep).withColumn("piece_idx", F.lit(0)).withColumn("occurrence", F.col("occurrence").cast("long"))
    return phrase.unionByName(speaker).unionByName(ranges)


def segments(moded: DataFrame, transcripts: DataFrame, sentences: DataFrame, matching: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The periods of ``periods``, numbered by ``numbered_segments``."""
    return numbered_segments(periods(moded, transcripts, sentences, matching))


def numbered_segments(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """request_id, media_id, piece_idx, seg_idx, start_ms, end_ms and the columns to ``keep``: periods numbered through each request.

    ``found``: what ``periods`` gives, best as a stored table, for it is read several times.
    """
    rows = numbered(found, "request_id", "piece_idx", "occurrence", "seg_idx")
    return rows.select("request_id", "media_id", "piece_idx", F.col("seg_idx").cast("int").alias("seg_idx"), "start_ms", "end_ms", *keep)


def lower_for_video(pieces: DataFrame, media: DataFrame) -> DataFrame:
    """Phrases of requests on video are matched in lower case."""
    known = pieces.join(media.select("media_id", "modality"), "media_id")
    return known.withColumn("phrase", F.when(F.col("modality") == "video", F.lower("phrase")).otherwise(F.col("phrase"))).drop("modality")
