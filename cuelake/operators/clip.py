"""Cutting transcripts to periods: bounds, cues, timelines, subtitles, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import detokenize, trim_marks
from ..functions.timecode import format_time
from ..sources.transcripts import SAMPLES_PER_MS
from .intervals import points_in
from .running import numbered, running

# The texts of the clip log.
NOTHING = "No period found in the {}, return raw speech. You may check the recognition result and try other destination text."
FAILED = "(Bracket detected in dest_text but offset time matching failed)"
SEVERAL = "(offsets detected but sub-sentence matched to several periods, offsets are applied to all periods)"


#: What the bounds of a segment take from its request.
REQUEST = ("modality", "start_ost", "end_ost", "n_ms")


def bounds(segments: DataFrame, moded: DataFrame) -> DataFrame:
    """Segments with what is cut and what subtitles see.

    Audio: offsets apply once, clamped to the medium, to both.  Video: offsets
    apply to the cut without a clamp; subtitles see the bare period.
    """
    return bounded(segments.join(moded.select("request_id", *REQUEST), "request_id"))


def bounded(rows: DataFrame) -> DataFrame:
    """``bounds`` of segments that have the columns REQUEST of their requests already."""
    audio = F.col("modality") == "audio"
    clamp = lambda x: F.when(audio, F.least(F.greatest(F.lit(0).cast("long"), x), F.col("n_ms"))).otherwise(x)
    rows = rows.withColumn("cut_start_ms", clamp(F.col("start_ms") + F.col("start_ost"))).withColumn("cut_end_ms", clamp(F.col("end_ms") + F.col("end_ost")))
    rows = rows.withColumn("cue_start_ms", F.when(audio, F.col("cut_start_ms")).otherwise(F.col("start_ms"))).withColumn("cue_end_ms", F.when(audio, F.col("cut_end_ms")).otherwise(F.col("end_ms")))
    rows = rows.withColumn("cut_start_sample", F.col("cut_start_ms") * SAMPLES_PER_MS).withColumn("cut_end_sample", F.col("cut_end_ms") * SAMPLES_PER_MS)
    return rows.select("request_id", "media_id", "modality", "seg_idx", "cut_start_ms", "cut_end_ms", "cut_start_sample", "cut_end_sample", "cue_start_ms", "cue_end_ms")


#: The blocks of time in which periods and tokens meet, about twenty tokens of speech.
BLOCK_MS = 4000


def _time_block(x: Column) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(BLOCK_MS)), F.lit(BLOCK_MS))


def _runs(sentences: DataFrame) -> DataFrame:
    """media_id, sent_idx, s_start, slot, items: the tokens of each sentence that end in one block of time, as one row; items: tok_idx, token, start_ms, end_ms."""
    at = F.transform(F.col("timestamp.end_ms"), _time_block)
    item = lambda x, i: F.struct(i.alias("tok_idx"), x.alias("token"), F.get("timestamp", i).start_ms.alias("start_ms"), F.get("timestamp", i).end_ms.alias("end_ms"))
    rows = sentences.where("size(tokens) > 0").select("media_id", "sent_idx", F.get("timestamp", F.lit(0)).start_ms.alias("s_start"), F.transform("tokens", item).alias("items"), at.alias("at"))
    # Where times fall inside a sentence, its tokens are brought together block by block.
    both = F.array_sort(F.zip_with("at", "items", lambda b, x: F.struct(b.alias("b"), x.tok_idx.alias("i"), x.alias("x"))))
    rows = rows.withColumn("rising", F.col("at") == F.array_sort("at"))
    rows = rows.select("media_id", "sent_idx", "s_start", F.when(F.col("rising"), F.col("items")).otherwise(F.transform(both, lambda x: x.x)).alias("items"), F.array_sort("at").alias("at"))
    ahead = F.concat(F.array(F.get("at", F.lit(0)) - 1), F.slice("at", F.lit(1), F.size("at") - 1))
    begins = F.array_compact(F.transform(F.zip_with("at", ahead, lambda x, y: x != y), lambda c, i: F.when(c, i)))
    rows = rows.select("media_id", "sent_idx", "s_start", "items", "at", begins.alias("begins"))
    run = lambda b, k: F.struct(F.get("at", b).alias("slot"), F.slice("items", b + 1, F.coalesce(F.get("begins", k + 1), F.size("items")) - b).alias("items"))
    return rows.select("media_id", "sent_idx", "s_start", F.explode(F.transform("begins", run)).alias("r")).select("media_id", "sent_idx", "s_start", "r.*")


def partial_sentences(cut: DataFrame, sentences: DataFrame) -> DataFrame:
    """request_id, modality, seg_idx, sent_idx, rel_start_ms, rel_end_ms, text: the tokens of each sentence that end inside a period.

    Tokens are dealt by blocks of time, those of a sentence in one block as one
    row.  A period inside a block meets its tokens there and is done; of a longer
    one it is told first, by a few larger blocks however long it is and over rows
    without tokens, which blocks with tokens it has, and what it takes of a sentence is put
    together.  So tokens go through one exchange, and no period is held against a medium.
    """
    runs = _runs(sentences)
    asked = cut.select("request_id", "media_id", "modality", "seg_idx", "cue_start_ms", "cue_end_ms", _time_block(F.col("cue_start_ms") + 1).alias("low"), _time_block(F.col("cue_end_ms")).alias("high"))
    asked = asked.where("cue_start_ms < cue_end_ms")
    ends_in = lambda x: (x.end_ms > F.col("cue_start_ms")) & (x.end_ms <= F.col("cue_end_ms"))
    key = ["request_id", "modality", "seg_idx", "sent_idx", "cue_start_ms"]
    inside = asked.where("low = high").withColumnRenamed("low", "slot").drop("high")
    blocks = F.array_distinct(F.transform(F.col("timestamp.end_ms"), _time_block))
    held = sentences.where("size(tokens) > 0").select("media_id", F.explode(blocks).alias("slot")).distinct()
    longer = points_in(held, asked.where("low < high").withColumn("high", F.col("high") + 1), "media_id", "slot", "low", "high", 1).drop("low", "high")

    def taken(rows: DataFrame) -> DataFrame:
        # One list or none, so that the tokens are looked through once.
        some = F.filter(F.array(F.filter("items", ends_in)), lambda w: F.size(w) > 0)
        return rows.join(runs, ["media_id", "slot"]).where("s_start < cue_end_ms").select(*key, F.explode(some).alias("x"))

    first, last = F.get("x", F.lit(0)), F.element_at("x", -1)
    alone = taken(inside).select(*key, first.start_ms.alias("start_ms"), last.end_ms.alias("end_ms"), F.col("x.token").alias("words"))
    # Of a token of a longer period only its number and its text are gathered, of a run its first and its last time.
    run = F.struct(F.col("x.tok_idx").alias("i"), F.col("x.token").alias("t"), first.start_ms.alias("a"), last.end_ms.alias("b"))
    several = taken(longer).select(*key, run.alias("r")).groupBy(*key).agg(F.collect_list("r").alias("r"))
    start = F.array_min(F.transform("r", lambda r: F.struct(F.get(r.i, F.lit(0)), r.a.alias("a")))).a
    end = F.array_max(F.transform("r", lambda r: F.struct(F.element_at(r.i, -1), r.b.alias("b")))).b
    words = F.transform(F.sort_array(F.flatten(F.transform("r", lambda r: F.arrays_zip(r.i.alias("i"), r.t.alias("t"))))), lambda w: w.t)
    rows = alone.unionByName(several.select(*key, start.alias("start_ms"), end.alias("end_ms"), words.alias("words")))
    begin = F.col("cue_start_ms")
    return rows.select("request_id", "modality", "seg_idx", "sent_idx", (F.col("start_ms") - begin).alias("rel_start_ms"), (F.col("end_ms") - begin).alias("rel_end_ms"), detokenize(F.col("words")).alias("text"))


def timeline(cut: DataFrame, partial: DataFrame) -> DataFrame:
    """request_id, seg_idx, cut_start_ms, cut_end_ms, out_start_ms: the edit list of video requests.

    A later segment without subtitles is left out; the first one always stays.
    """
    return timed(shown(cut, partial))


def shown(cut: DataFrame, partial: DataFrame) -> DataFrame:
    """request_id, seg_idx, cut_start_ms, cut_end_ms of the segments in the edit list."""
    counts = partial.where("modality = 'video'").groupBy("request_id", "seg_idx").agg(F.count("*").alias("n"))
    kept = cut.where("modality = 'video'").select("request_id", "seg_idx", "cut_start_ms", "cut_end_ms")
    return kept.join(counts, ["request_id", "seg_idx"], "left").where("seg_idx = 0 or n > 0").drop("n")


def timed(kept: DataFrame) -> DataFrame:
    """The edit list of what ``shown`` has given, best as a stored table."""
    return running(kept, ["request_id"], "seg_idx", F.col("cut_end_ms") - F.col("cut_start_ms"), "out_start_ms", nulls=False).select("request_id", "seg_idx", "cut_start_ms", "cut_end_ms", "out_start_ms")


def cues(partial: DataFrame, line: DataFrame) -> DataFrame:
    """Partial sentences numbered through each request, with times in the output (video) or the segment (audio)."""
    rows = numbered(partial, "request_id", "seg_idx", "sent_idx", "before", nulls=False, beside=line.select("request_id", "seg_idx", "out_start_ms"))
    rows = rows.withColumn("out_start_ms", F.coalesce("out_start_ms", F.lit(0).cast("long")))
    return rows.select(
        "request_id", "seg_idx", "sent_idx", (F.col("before") + 1).cast("int").alias("cue_no"), (F.col("rel_start_ms") + F.col("out_start_ms")).alias("rel_start_ms"), (F.col("rel_end_ms") + F.col("out_start_ms")).alias("rel_end_ms"), "text"
    )


def rebased(partial: DataFrame) -> DataFrame:
    """Later video segments' subtitle times, so that the first one of each starts at 0."""
    later = partial.where("modality = 'video' and seg_idx > 0")
    first = later.groupBy("request_id", "seg_idx").agg(F.min_by("rel_start_ms", "sent_idx").alias("first"))
    return later.join(first, ["request_id", "seg_idx"]).select("request_id", "seg_idx", "sent_idx", (F.col("rel_start_ms") - F.col("first")).alias("start_ms"), (F.col("rel_end_ms") - F.col("first")).alias("end_ms"))


def cue_block(start: Column, end: Column, text: Column) -> Column:
    return F.concat(format_time(start), F.lit(" --> "), format_time(end), F.lit("\n"), text, F.lit("\n"))


def _ordered(order: str, block: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x.b), "")


#: Cues in one part of a document.
PART = 1000


def _parts(cues: DataFrame, key: str, number: str, block: Column, part: int) -> DataFrame:
    """key, part, srt: the documents in parts of ``part`` cues; a document is its parts one after the other."""
    place = F.call_function("div", F.col(number) - 1, F.lit(part)).cast("long")
    return cues.withColumn("part", place).groupBy(key, "part").agg(_ordered(number, block).alias("srt"))


def whole(parts: DataFrame, key: str) -> DataFrame:
    """key, srt: each document in a row."""
    return parts.groupBy(key).agg(_ordered("part", F.col("srt")).alias("srt"))


def clip_srt_parts(numbered_cues: DataFrame, part: int = PART) -> DataFrame:
    """request_id, part, srt: a request's subtitles in parts, so that no row holds a long document."""
    block = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), cue_block(F.col("rel_start_ms"), F.col("rel_end_ms"), F.col("text")))
    return _parts(numbered_cues, "request_id", "cue_no", block, part)


def clip_srt(numbered_cues: DataFrame) -> DataFrame:
    """request_id, srt: a request's subtitles."""
    return whole(clip_srt_parts(numbered_cues), "request_id")


def full_srt_parts(sentences: DataFrame, part: int = PART) -> DataFrame:
    """media_id, part, srt: a medium's subtitles in parts, with speakers where they are known."""
    spans = sentences.select("media_id", "sent_idx", "spk", "text", F.element_at("timestamp", 1).start_ms.alias("start_ms"), F.element_at("timestamp", -1).end_ms.alias("end_ms"))
    rows = running(spans, ["media_id"], "sent_idx", F.lit(1), "before").withColumn("no", F.col("before") + 1)
    block = cue_block(F.col("start_ms"), F.col("end_ms"), trim_marks(F.col("text")))
    number = F.col("no").cast("string")
    line = F.when(F.col("spk").isNotNull(), F.concat(number, F.lit("  spk"), F.col("spk").cast("string"), F.lit("\n"), block)).otherwise(F.concat(number, F.lit("\n"), block, F.lit("\n")))
    return _parts(rows, "media_id", "no", line, part)


def full_srt(sentences: DataFrame) -> DataFrame:
    """media_id, srt: a medium's subtitles, with speakers where they are known."""
    return whole(full_srt_parts(sentences), "media_id")


def write_srt(table: DataFrame, path: str, key: str, buckets: int = 8) -> None:
    """Subtitle documents as text, in a few folders by a hash of the key."""
    table.select("srt", F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).write.partitionBy("bucket").text(path)


def write_srt_documents(table: DataFrame, path: str, key: str, buckets: int = 8) -> None:
    """Subtitle documents as JSON lines (key, srt), so that each can be traced, in a few folders by a hash of the key."""
    table.select(key, "srt", F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")).write.partitionBy("bucket").json(path)


def read_srt_documents(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, srt) of what ``write_srt_documents`` has written."""
    return spark.read.schema(f"{key} long, srt string").json(path).select(key, "srt")


def srt_names(names: DataFrame, media: DataFrame, clips: DataFrame, full: DataFrame) -> DataFrame:
    """(file, part, srt): a medium's subtitles as total.srt in its own folder, a clip's beside it under its name.

    ``clips`` and ``full`` are documents in parts.  ``names``: request_id,
    clip_file of video requests; clips of audio are result.wav of their request.
    """
    own = F.concat(F.regexp_extract("path", r"([^/]*?)(\.[^./]+)?$", 1), F.lit("/"))
    total = full.join(media.select("media_id", "path"), "media_id").select(F.concat(own, F.lit("total.srt")).alias("file"), "part", "srt")
    clip_file = F.coalesce("clip_file", F.concat(F.lit("request"), F.col("request_id").cast("string"), F.lit("/result.wav")))
    shown = clips.join(names.select("request_id", "clip_file"), "request_id", "left")
    return total.unionByName(shown.select(F.concat(F.substring(clip_file, F.lit(1), F.length(clip_file) - 3), F.lit("srt")).alias("file"), "part", "srt"))


def log(moded: DataFrame, cut: DataFrame, line: DataFrame, pieces: DataFrame, found: DataFrame) -> DataFrame:
    """request_id, n_periods, message: how many periods a request has, and what was cut, in seconds."""
    seconds = lambda c: F.format_string("%.3f", F.col(c) / 1000.0)
    span = F.concat(F.lit("from "), seconds("cut_start_ms"), F.lit(" to "), seconds("cut_end_ms"))
    shown = cut.where("modality = 'audio'").select("request_id", "seg_idx", "cut_start_ms", "cut_end_ms").unionByName(line.drop("out_start_ms"))
    texts = shown.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", span.alias("s")))), lambda x: x.s), ", ").alias("spans"))
    counts = cut.groupBy("request_id").agg(F.count("*").alias("n_periods"))
    hits = found.groupBy("request_id", "piece_idx").agg(F.count("*").alias("hits"))
    last = pieces.join(hits, ["request_id", "piece_idx"], "left").groupBy("request_id").agg(F.max(F.struct("piece_idx", "bracket_failed", "bracket_matched", "hits")).alias("p"))
    note = F.when(F.col("p.bracket_failed"), FAILED).when(F.col("p.bracket_matched") & (F.col("p.hits") > 1), SEVERAL).otherwise("")
    notes = last.select("request_id", note.alias("note"))
    rows = moded.select("request_id", "modality", "mode").join(counts, "request_id", "left").join(texts, "request_id", "left").join(notes, "request_id", "left")
    place = F.when(F.col("modality") == "audio", "speech").otherwise("audio")
    appended = F.when((F.col("modality") == "audio") & (F.col("mode") == "phrase"), F.coalesce("note", F.lit(""))).otherwise("")
    some = F.concat(F.col("n_periods").cast("string"), F.lit(" periods found in the "), place, F.lit(": "), "spans", appended)
    none = F.when(F.col("modality") == "audio", NOTHING.format("speech")).otherwise(NOTHING.format("audio"))
    return rows.select("request_id", F.coalesce("n_periods", F.lit(0)).cast("long").alias("n_periods"), F.when(F.col("n_periods").isNull(), none).otherwise(some).alias("message"))


def manifest(moded: DataFrame, media: DataFrame, answered: DataFrame) -> DataFrame:
    """request_id, clip_file, temp_file: output names of video requests with a period, those in ``answered``, numbered in each medium."""
    done = moded.where("modality = 'video'").select("request_id", "media_id").join(answered.select("request_id").distinct(), "request_id", "left_semi").join(media.select("media_id", "path"), "media_id")
    no = (F.row_number().over(Window.partitionBy("media_id").orderBy("request_id")) - 1).cast("string")
    base = F.regexp_extract("path", r"([^/]*?)(\.[^./]+)?$", 1)
    return done.select("request_id", F.concat(base, F.lit("_clip_no"), no, F.lit(".mp4")).alias("clip_file"), F.concat(base, F.lit("_clip_tempaudio_no"), no, F.lit(".mp4")).alias("temp_file"))
