"""Table shapes.  All times are whole milliseconds from the start of a recording."""

from pyspark.sql.types import StructType, _parse_datatype_string


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


WORDS = "array<struct<start:bigint,end:bigint,word:string>>"
RECORDINGS = "recording_id string, duration bigint"
SEGMENTS = f"recording_id string, pass_id int, seg_ord int, start bigint, end bigint, text string, avg_logprob double, no_speech_prob double, words {WORDS}"
SPANS = "recording_id string, a bigint, b bigint, label string"
PATCH_ROWS = f"recording_id string, span_ord int, a bigint, b bigint, label string, attempt_ord int, mode string, row_ord int, start bigint, end bigint, text string, words {WORDS}"
ENERGY = "recording_id string, frame_ord bigint, n_samples bigint, sum_sq double"
EDITS = "array<struct<pos:int,from:string,to:string>>"
CUES = "recording_id string, cue_ord int, start bigint, end bigint, text string"
FIXES = "ord int, wrong string, right string"
TERMS = "ord int, term string"
