"""What speech-to-text clients return: a log of updates, and one response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPDATE = "struct<kind:string,text:string,start:double,end:double,model_id:string>"


def _update(kind: str, text: Column, start: Column, end: Column, model: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), start.alias("start"), end.alias("end"), model.alias("model_id")).cast(UPDATE)


def update_log(results: DataFrame, key: str, text: str = "text", segments: str = "segments", error: str | None = None, model_id: str | None = None) -> DataFrame:
    """seq, kind, text, start, end, model_id for each result: SessionOpen, TextUpdated ..., Error if there is one, SessionClose."""
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    model = F.lit(model_id).cast("string")
    parts = F.transform(segments, lambda s: _update("TextUpdated", s["text"], s["start"], s["end"], model))
    whole = F.array(_update("TextUpdated", F.col(text), none, none, model))
    updates = F.when(F.size(segments) > 0, parts).otherwise(whole)
    if error:
        failed = F.array(_update("Error", F.col(error), none, none, model))
        updates = F.when(F.col(error).isNull(), updates).otherwise(failed)
    log = F.concat(F.array(_update("SessionOpen", no_text, none, none, no_text)), updates, F.array(_update("SessionClose", no_text, none, none, no_text)))
    return results.select(key, F.posexplode(log).alias("seq", "u")).select(key, "seq", "u.*")


def response(results: DataFrame, key: str, text: str = "text", segments: str = "segments", tokens: str = "token_ids") -> DataFrame:
    """text, start of the first and end of the last segment, their number and that of the tokens."""
    return results.select(
        key, text, F.get(segments, F.lit(0))["start"].alias("start"), F.try_element_at(segments, F.lit(-1))["end"].alias("end"),
        F.size(segments).alias("n_segments"), F.size(tokens).alias("n_tokens"),
    )
