"""Parsing of scorer answers as Column expressions (no Python per row).

Labels are matched with higher-order functions over a literal label array,
so the first label *in label order* wins, as configured.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmap.functions.text import col_, strip
from gridmap.plans import defaults as D

# tags a class answer may use; both spellings are accepted
CLASS_TAG_RE = r"(?is)<(?:sol|class)>(.*?)</(?:sol|class)>"
VALIDATION_CLASS_RE = r"(?is)<class>(.*?)</class>"
CONFIDENCE_RE = r"(?is)<confidence>(.*?)</confidence>"
REASON_RE = r"(?is)<reason>(.*?)</reason>"


def _spellings(labels) -> list[tuple[str, str]]:
    """(spelling, label) in label order, each label followed by its synonyms."""
    return [(w, x) for x in labels for w in [x, *[k for k, v in D.LABEL_SYNONYMS.items() if v == x]]]


def label_exact(raw: Column, labels) -> Column:
    """First label equal to ``raw`` ignoring case (null when none)."""
    return F.coalesce(*[F.when(F.lower(raw) == F.lit(w.lower()), F.lit(x)) for w, x in _spellings(labels)])


def label_contained(raw: Column, labels) -> Column:
    """First label (in label order) contained in ``raw`` ignoring case."""
    return F.coalesce(*[F.when(F.instr(F.lower(raw), F.lit(w.lower())) > 0, F.lit(x)) for w, x in _spellings(labels)])


def label_word(answer: Column, labels) -> Column:
    """First label found as a whole word (case-insensitive) anywhere in the answer."""
    return F.coalesce(*[F.when(answer.rlike("(?i)\\b\\Q" + w + "\\E\\b"), F.lit(x)) for w, x in _spellings(labels)])


def _tag(answer: Column, pattern: str) -> Column:
    """Stripped group 1 of the first match, null when the tag is absent."""
    return F.when(answer.rlike(pattern), strip(F.regexp_extract(answer, pattern, 1)))


def _none_of_those(raw: Column, none_label: str) -> Column:
    return F.when(F.instr(F.lower(raw), F.lit(none_label.lower())) > 0, F.lit(none_label))


def parse_class(answer, labels=D.CLASS_LABELS, none_label: str = D.NONE_LABEL) -> Column:
    """struct(predicted_class, confidence) from a class answer.

    Tag content: exact label (ignoring case), else a label contained in it,
    else 'none of those'; then any label as a whole word in the whole
    answer.  Confidence Medium when a real class was found, else Low.
    """
    answer = F.coalesce(col_(answer), F.lit(""))
    raw = _tag(answer, CLASS_TAG_RE)
    found = F.coalesce(
        F.when(raw.isNotNull(), F.coalesce(label_exact(raw, labels), label_contained(raw, labels),
                                           _none_of_those(raw, none_label))),
        label_word(answer, labels))
    cls = F.coalesce(found, F.lit(none_label))
    conf = F.when(found.isNotNull() & (found != F.lit(none_label)), F.lit("Medium")).otherwise(F.lit("Low"))
    return F.struct(cls.alias("predicted_class"), conf.alias("confidence"))


def parse_class_validation(answer, labels=D.CLASS_LABELS, none_label: str = D.NONE_LABEL) -> Column:
    """struct(predicted_class, confidence, validation_reason) from a validation answer.

    ``<class>`` exact label, else 'none of those', else whole-word fallback;
    ``<confidence>`` text (default Low); ``<reason>`` text.  Nothing found ->
    None of those / Low / 'Failed to parse output.'
    """
    answer = F.coalesce(col_(answer), F.lit(""))
    raw = _tag(answer, VALIDATION_CLASS_RE)
    found = F.coalesce(
        F.when(raw.isNotNull(), F.coalesce(label_exact(raw, labels), _none_of_those(raw, none_label))),
        label_word(answer, labels))
    conf = F.coalesce(_tag(answer, CONFIDENCE_RE), F.lit("Low"))
    reason = _tag(answer, REASON_RE)
    return F.struct(
        F.coalesce(found, F.lit(none_label)).alias("predicted_class"),
        F.when(found.isNotNull(), conf).otherwise(F.lit("Low")).alias("confidence"),
        F.when(found.isNotNull(), reason).otherwise(F.lit("Failed to parse output.")).alias("validation_reason"))


def class_answer(label: Column, confidence: Column) -> Column:
    """The answer text a class scorer returns."""
    return F.concat(F.lit("<class>"), label, F.lit("</class><confidence>"), confidence, F.lit("</confidence>"))
