"""Answer extraction: a cascade of rules over a response, first success wins.

Within a rule the last match wins. Think blocks are removed first. The labels
of the question, in upper case and side by side, form the class of letters a
rule may match; a question without labels matches no letter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, norm_value, strip_think

# The wording of the rules that name a letter, in their order.
LETTER_RULES = (
    ("final_answer", r"FINAL\s*ANSWER"),
    ("answer_is", r"(?:the\s+)?answer\s+is"),
    ("option", r"(?:correct\s+option|option)"),
)
# The wording behind which a value may stand.
VALUE_RULES = (r"FINAL\s*ANSWER\s*[:\-]?\s*(.+)", r"(?:the\s+)?answer\s+is\s*[:\-]?\s*([^\n.]+)")
#: A tail letter is looked for in so many last characters.
TAIL = 200


def last_match(text: Column, pattern: Column, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(group)), F.lit(-1))


def extract(response: Column, labels: Column, texts: Column | None = None) -> Column:
    """``struct<pred, method>``, both null where no rule succeeds or the response is null."""
    upper = F.transform(labels, lambda x: F.upper(x))
    return let(strip_think(response), lambda text: let(F.array_join(upper, ""), lambda letters: _cascade(text, letters, upper, texts)))


def _cascade(text: Column, letters: Column, upper: Column, texts: Column | None) -> Column:
    known = F.length(letters) > 0
    found = []
    for name, lead in LETTER_RULES:
        pattern = F.concat(F.lit(rf"(?id){lead}\s*[:\-]?\s*\(?(["), letters, F.lit(r"])\b\)?"))
        found.append((name, F.when(known, F.upper(last_match(text, pattern, 1)))))

    if texts is not None:
        candidate = F.coalesce(*(last_match(text, F.lit("(?id)" + rule), 1) for rule in VALUE_RULES))
        pairs = F.filter(F.arrays_zip(upper.alias("l"), texts.alias("t")), lambda p: p["l"].isNotNull() & p["t"].isNotNull())

        def matched(value: Column) -> Column:
            hits = F.filter(pairs, lambda p: norm_value(p["t"]) == value)
            return F.when(value != "", let(hits, lambda h: F.when(F.size(h) == 1, h[0]["l"])))

        found.append(("value_match", let(norm_value(candidate), matched)))

    tail = F.right(text, F.lit(TAIL))
    pattern = F.concat(F.lit(r"(?md)\(["), letters, F.lit(r"]\)|(?:^|\s)["), letters, F.lit(r"][).:]?\s*$"))
    # The match is a letter with brackets, blanks or marks around it.
    whole = F.when(known, last_match(tail, pattern, 0))
    found.append(("tail_letter", F.upper(F.nullif(F.regexp_replace(whole, r"[\s().:]", ""), F.lit("")))))

    # Each rule is evaluated once, and only where those before it have failed.
    def named(name: str) -> Callable[[Column], Column]:
        return lambda p: F.when(p.isNotNull(), F.struct(p.alias("pred"), F.lit(name).alias("method")))

    nothing = F.lit(None).cast("string")
    return F.coalesce(*(let(c, named(n)) for n, c in found), F.struct(nothing.alias("pred"), nothing.alias("method")))
