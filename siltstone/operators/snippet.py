"""The window of a text with most query terms, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW, LONGEST = 30, 200


def words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")


def snippet(text: Column, terms: list[str], longest: int = LONGEST) -> Column:
    """Empty without text; a text of at most longest // 5 words from its start; else the first window of 30 words with
    most terms as substrings, dots where text is left out, cut to ``longest``."""
    w = words(text)

    def step(s: Column, x: Column) -> Column:
        """One word on: where each term was last seen, and the best window that has ended."""
        seen = [F.when(F.lower(x).contains(t), s["i"]).otherwise(s[f"t{k}"]) for k, t in enumerate(terms)]
        hits = sum(((at > s["i"] - WINDOW).cast("int") for at in seen), F.lit(0))
        start = s["i"] - (WINDOW - 1)
        better = (start >= 0) & (hits > s["best"])
        fields = [(s["i"] + 1).alias("i"), *[at.alias(f"t{k}") for k, at in enumerate(seen)]]
        return F.struct(*fields, F.when(better, hits).otherwise(s["best"]).alias("best"), F.when(better, start).otherwise(s["at"]).alias("at"))

    never = F.lit(-(1 << 30))
    start = F.struct(F.lit(0).alias("i"), *[never.alias(f"t{k}") for k in range(len(terms))], F.lit(0).alias("best"), F.lit(0).alias("at"))
    best = F.aggregate(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), start, step, lambda s: s["at"])

    def show(found: Column) -> Column:
        at, w = found["at"], found["w"]
        body = F.array_join(F.slice(w, at + 1, WINDOW), " ")
        return F.concat(F.when(at > 0, "...").otherwise(""), body, F.when(at + WINDOW < F.size(w), "...").otherwise(""))

    shown = F.element_at(F.transform(F.array(F.struct(best.alias("at"), w.alias("w"))), show), 1)  # best is found once
    whole = F.when(F.coalesce(text, F.lit("")) == "", "").when(F.size(w) <= longest // 5, F.substring(text, 1, longest))
    return whole.otherwise(F.substring(shown, 1, longest))
