"""Column functions over sequence text. All are native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixmill.constants import D_RESIDUES, L_RESIDUES, PREFIX, SUFFIX

VALID = rf"\A[{L_RESIDUES}{D_RESIDUES}]+\z"


def tokenize(s: Column) -> Column:
    """Characters and ``<...>`` tokens; a stray ``>`` and an unterminated tail are dropped."""
    open_tail = F.contains(F.substring_index(s, ">", -1), F.lit("<"))
    whole = F.when(open_tail, F.regexp_replace(s, r"<[^>]*\z", "")).otherwise(s)
    return F.regexp_extract_all(whole, F.lit(r"<[^>]*>|[^<>]"), F.lit(0))


def frame(s: Column) -> Column:
    return F.concat(F.lit(PREFIX), s, F.lit(SUFFIX))


def raw_sequence(s: Column) -> Column:
    """Text between the first ``>`` and the next ``<``."""
    return F.get(F.split(F.get(F.split(s, ">"), F.lit(1)), "<"), F.lit(0))


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def extract_payload(s: Column) -> Column:
    """Between the first ``<SOS>`` and the next ``<EOS>`` of its line; where no line has both, the text without white space around it."""
    start = F.instr(s, "<SOS>")
    end = F.call_function("locate", F.lit("<EOS>"), s, start + 5)
    one_line = F.when((start > 0) & (end > 0), F.substring(s, start + 5, end - start - 5)).otherwise(strip(s))
    framed = F.regexp_substr(s, F.lit(r"<SOS>[^\n]*?<EOS>"))
    lines = F.when(framed.isNotNull(), F.substring(framed, F.lit(6), F.length(framed) - 10)).otherwise(strip(s))
    return F.when(F.contains(s, F.lit("\n")), lines).otherwise(one_line)


def is_valid(s: Column) -> Column:
    return F.coalesce(s.rlike(VALID), F.lit(False))


def residue_slice(s: Column) -> Column:
    """Between the second ``>`` and the next ``<``; where there are none, the text without its tokens."""
    second = F.when(F.instr(s, ">") > 0, F.call_function("locate", F.lit(">"), s, F.instr(s, ">") + 1)).otherwise(F.lit(0))
    after = F.when(second > 0, F.call_function("locate", F.lit("<"), s, second + 1)).otherwise(F.lit(0))
    return F.when(after > 0, F.substring(s, second + 1, after - second - 1)).otherwise(F.regexp_replace(s, "<[^>]+>", ""))


def clean_residues(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(s)), f"[^{L_RESIDUES}]", "")


def occurrences(s: Column, token: str) -> Column:
    """0-based positions of all non-overlapping occurrences of ``token``."""
    parts = F.split(s, rf"\Q{token}\E", -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.length)
    ends = F.aggregate(
        lengths,
        F.array().cast("array<int>"),
        lambda acc, n: F.concat(acc, F.array(F.when(F.size(acc) == 0, n).otherwise(F.element_at(acc, -1) + len(token) + n))),
    )
    return ends


def crop_terminus(s: Column, length: Column) -> Column:
    """Text up to the C-terminal tokens after the first ``<EOS>``; ``length`` limits their position."""
    i = F.instr(s, "<EOS>") - 1
    rest = F.substring(s, i + 6, F.length(s))
    keep = (
        F.when(rest.startswith("<AMD>") & (i + 10 < length), i + 10)
        .when(rest.startswith("<cblank>") & (i + 13 < length), i + 13)
        .otherwise(i + 5)
    )
    return F.when(i >= 0, F.substring(s, F.lit(1), keep)).otherwise(s)


def residues(s: Column) -> Column:
    """The characters of a text, as an array."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def parse_flag(s: Column, accept: tuple[str, ...] = ("true",)) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin(*accept), F.lit(False))
