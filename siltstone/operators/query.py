"""Query language and matching."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.config import Settings
from siltstone.functions import text as tx
from siltstone.operators.index import Index
from siltstone.operators.rank import contributions, ranked

SINGLE, AND, OR, PHRASE = "SINGLE_TERM", "MULTI_TERM_AND", "MULTI_TERM_OR", "PHRASE"


@dataclass(frozen=True)
class ParsedQuery:
    raw: str
    kind: str = SINGLE
    terms: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    phrase: str | None = None


def parse(query: str | None, stemmer: str = "suffix") -> ParsedQuery:
    """Quoted text is a phrase; `` OR `` between words takes any; words after ``-`` are excluded; else all words."""
    raw = (query or "").strip()
    if not raw:
        return ParsedQuery(query or "")
    if len(raw) > 2 and raw[0] == raw[-1] == '"':
        return ParsedQuery(raw, PHRASE, tx.py_terms(raw[1:-1], stemmer), [], raw[1:-1])
    if " OR " in raw:
        found = [t for part in raw.split(" OR ") for t in tx.py_terms(part, stemmer)]
        return ParsedQuery(raw, OR, list(dict.fromkeys(found)))
    excluded = [w[1:] for w in raw.split() if w[0] == "-" and len(w) > 1]
    wanted = [w for w in raw.split() if w[0] != "-" or len(w) == 1]
    terms = tx.py_terms(" ".join(wanted), stemmer)
    return ParsedQuery(raw, AND if len(terms) > 1 else SINGLE, terms, tx.py_terms(" ".join(excluded), stemmer))


def phrase_docs(index: Index, terms: list[str]) -> DataFrame:
    """Documents (doc_id) in which the terms stand one after the other: positions less their place in the phrase meet."""
    if not terms:
        return index.postings.select("doc_id").limit(0)
    post = index.lookup(terms)
    if len(terms) == 1:
        return post.select("doc_id").distinct()
    places = {t: [i for i, x in enumerate(terms) if x == t] for t in terms}
    place = F.create_map(*[x for t, at in places.items() for x in (F.lit(t), F.array(*[F.lit(i) for i in at]))])
    each = post.select("doc_id", "positions", F.explode(F.element_at(place, F.col("term"))).alias("i"))
    each = each.select("doc_id", "i", F.explode("positions").alias("p")).select("doc_id", (F.col("p") - F.col("i")).alias("start"), "i")
    return each.groupBy("doc_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(terms)).select("doc_id").distinct()


def and_docs(index: Index, terms: list[str], strict: bool = True) -> DataFrame:
    """Documents with all terms. Unless ``strict``, terms that no document has don't count."""
    different = sorted(set(terms))
    post = index.lookup(different)
    need: int = len(different)
    if not strict:
        need = index.term_stats.where(F.col("term").isin(*different)).count()
    return post.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == need).select("doc_id")


def search(index: Index, query: ParsedQuery, settings: Settings = Settings()) -> DataFrame:
    """All matches, unsorted: doc_id, score (six places), first_ord (place of the first matching term), matched_terms.

    Terms and their multiplicity are literals in the plan; the postings scan is pruned by shard and term, and one
    shuffle by doc_id adds up scores, checks AND, and applies exclusions together."""
    if not query.terms or not index.total_docs:
        return ranked(contributions(index, {}, {}, settings))
    count = Counter(query.terms)
    order = {t: i for i, t in reversed(list(enumerate(query.terms)))}
    scores = contributions(index, count, order, settings)
    out = ranked(scores)
    if query.kind == AND:
        out = out.join(and_docs(index, query.terms, not settings.compat), "doc_id", "left_semi")
    if query.kind == PHRASE:
        out = out.join(phrase_docs(index, query.terms), "doc_id", "left_semi")
    ignored = settings.compat and query.kind == AND
    if query.negative and not ignored:
        out = out.join(index.lookup(query.negative).select("doc_id"), "doc_id", "left_anti")
    return out
