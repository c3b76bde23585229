"""Language-model prompts and the media manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled

# Suffixes of media files, providers by model name, and their addresses.
AUDIO = ["wav", "mp3", "aac", "m4a", "flac"]
VIDEO = ["mp4", "avi", "mkv", "flv", "mov", "webm", "ts", "mpeg"]
DEEPSEEK = "https://api.deepseek.com"
MOONSHOT = "https://api.moonshot.cn/v1"


def routed(rows: DataFrame) -> DataFrame:
    """Rows with ``model`` and provider, sent_model, base_url, reason."""
    model = F.col("model")
    provider = F.when(model.startswith("qwen"), "qwen").when(model.startswith("gpt") | model.startswith("moonshot") | model.startswith("deepseek"), "openai").when(model.startswith("g4f"), "g4f")
    sent = F.when(model.startswith("g4f"), F.regexp_replace(model, "^[^-]*-?", "")).otherwise(model)
    url = F.when(model.startswith("deepseek"), DEEPSEEK).when(model.startswith("gpt-3.5-turbo"), MOONSHOT)
    return rows.withColumns({"provider": provider, "sent_model": F.when(provider.isNotNull(), sent), "base_url": F.when(provider == "openai", url), "reason": F.when(provider.isNull(), "unknown model name")})


def messages(srt: DataFrame, system: Column, user: Column) -> DataFrame:
    """media_id, msg_idx, role, content: a system message where there is one, then the request and the subtitles."""
    part = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    ask = part("user", F.concat(user, F.lit("\n"), F.col("srt")))
    both = F.when(filled(system), F.array(part("system", system), ask)).otherwise(F.array(ask))
    return srt.select("media_id", F.posexplode(both).alias("msg_idx", "m")).select("media_id", "msg_idx", "m.role", "m.content")


def with_modality(files: DataFrame) -> DataFrame:
    """Files with ``modality`` by the suffix of their path, and ``reason`` why they are no use."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(AUDIO), "audio").when(suffix.isin(VIDEO), "video")
    has = F.col("has_audio") if "has_audio" in files.columns else F.lit(True)
    reason = F.when(kind.isNull(), "unsupported file").when((kind == "video") & ~has, "no audio track")
    return files.withColumns({"modality": kind, "reason": reason})


def media_manifest(media: DataFrame) -> DataFrame:
    """media_id, path, modality, reason: the modality by the suffix; others are kept with a reason."""
    return with_modality(media).select("media_id", "path", "modality", "reason")
