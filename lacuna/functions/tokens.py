"""Terms: tokenising, singular forms, query expansion, content words.

These run once per token, so they are written as SQL text: one expression each,
evaluated in the JVM.  `text` arguments are column names or SQL expressions.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna import values as V

TOKEN = r"[A-Za-z]+|\p{Nd}+(?:\.\p{Nd}+)*"
_STOPWORDS = ", ".join(f"'{w}'" for w in V.STOPWORDS)


def _keep(t: str) -> str:
    return rf"{t} NOT IN ({_STOPWORDS}) AND (length({t}) > 1 OR {t} RLIKE r'^\p{{Nd}}$')"


def _singular(t: str) -> str:
    n = f"length({t})"
    # Most terms do not end in s, so that is asked first; a term that does is all letters.
    stem = (
        f"CASE WHEN NOT endswith({t}, 's') OR {n} <= 3 THEN NULL "
        f"WHEN endswith({t}, 'ies') THEN concat(left({t}, {n} - 3), 'y') "
        f"WHEN endswith({t}, 'ses') OR endswith({t}, 'xes') OR endswith({t}, 'zes') "
        f"OR endswith({t}, 'ches') OR endswith({t}, 'shes') THEN left({t}, {n} - 2) "
        f"WHEN NOT (endswith({t}, 'ss') OR endswith({t}, 'us') OR endswith({t}, 'is')) THEN left({t}, {n} - 1) END"
    )
    return stem


def _raw_tokens(text: str) -> str:
    return f"transform(regexp_extract_all({text}, r'{TOKEN}', 0), t -> lower(t))"


def keep_token(token: str) -> Column:
    """Not a stopword, and more than one letter unless it is a digit."""
    return F.expr(_keep(token))


def singular(token: str) -> Column:
    """Singular form of a plural term, null where there is nothing to take off."""
    return F.expr(f"CASE WHEN ({_singular(token)}) NOT IN ({_STOPWORDS}) THEN {_singular(token)} END")


def raw_tokens(text: str) -> Column:
    return F.expr(_raw_tokens(text))


def _terms(text: str) -> str:
    kept = f"filter({_raw_tokens(text)}, t -> {_keep('t')})"
    pairs = f"transform({kept}, t -> array(t, {_singular('t')}))"
    # A null stem fails the test as well, and a kept token passes it again.
    return f"filter(flatten({pairs}), t -> t NOT IN ({_STOPWORDS}))"


def terms(text: str) -> Column:
    """Terms of a text in order; each plural is followed by its singular."""
    return F.expr(_terms(text))


_SYNONYM_CASES = " ".join(
    f"WHEN '{word}' THEN array({', '.join(repr(x) for x in extra)})" for word, extra in V.SYNONYMS.items()
)


def expanded(text: str) -> Column:
    """Terms of a question plus synonyms, one hop, repeats kept."""
    extra = f"flatten(transform({_terms(text)}, t -> CASE t {_SYNONYM_CASES} ELSE cast(array() AS array<string>) END))"
    return F.expr(f"concat({_terms(text)}, {extra})")


def content_words(text: str) -> Column:
    """Distinct words that carry content, for lexical overlap."""
    return F.expr(
        f"array_distinct(filter(regexp_extract_all(lower({text}), '[a-z0-9.]+', 0), "
        f"w -> length(w) > 2 AND w NOT IN ({_STOPWORDS})))"
    )


def overlap(claim_words: Column, quote_words: Column) -> Column:
    """Share of the claim's words found in the quote; null for an empty claim."""
    return F.try_divide(
        F.size(F.array_intersect(claim_words, quote_words)).cast("double"),
        F.size(claim_words).cast("double"),
    )


def wants_definition(question: Column) -> Column:
    return question.rlike(V.DEFINITION_INTENT)


def is_definition(text: Column) -> Column:
    return text.rlike(V.DEFINITION_CLAUSE)
