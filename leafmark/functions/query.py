"""Query understanding as column expressions over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rules as R
from leafmark.functions import text as X

ASPECT = "array<struct<id:string,query:string,keywords:array<string>>>"


def _all_that_apply(rows: list[tuple[str, list[str]]]) -> str:
    """SQL: the term arrays of all conditions that hold, concatenated."""
    empty = X.string_array([])
    return "concat(" + ", ".join(f"if({cond}, {X.string_array(terms)}, {empty})" for cond, terms in rows) + ")"


def _matches(column: str, pattern: str) -> str:
    return f"{column} rlike r'{pattern}'"


def _has(column: str, word: str) -> str:
    return f"contains({column}, '{word}')"


def inferred_identifiers(normalized: str) -> Column:
    rows = []
    for words, pattern, terms in R.INFERRED:
        conds = [_has(normalized, w) for w in words] + ([_matches(normalized, pattern)] if pattern else [])
        rows.append((" and ".join(conds), terms))
    return F.expr(_all_that_apply(rows))


def identifiers(normalized: str) -> Column:
    return F.array_distinct(
        F.concat(X.bounded_matches(F.col(normalized), R.IDENTIFIER), inferred_identifiers(normalized))
    )


def aliases(question: str, normalized: str) -> Column:
    found = f"array_distinct({_all_that_apply([(_matches(question, p), t) for p, t in R.ALIASES])})"
    return F.expr(f"if({_matches(normalized, R.CORE_TIMER)}, array_remove({found}, 'TIM'), {found})")


def peripherals(values: Column) -> Column:
    prefixes = X.strings(R.PERIPHERALS)
    first = F.transform(values, lambda v: F.get(F.filter(prefixes, lambda p: F.startswith(v, p)), F.lit(0)))
    return F.array_distinct(F.filter(first, lambda p: p.isNotNull()))


def intent(question: str) -> Column:
    cases = " ".join(f"when {_matches(question, p)} then '{name}'" for name, p in R.INTENTS)
    return F.expr(f"case {cases} else 'general' end")


def expand_concepts(normalized: str) -> Column:
    rows = [(_matches(normalized, p), terms.split()) for _, p, terms in R.CONCEPTS]
    return F.expr(f"array_distinct({_all_that_apply(rows)})")


def detect_concepts(normalized: str) -> Column:
    return F.expr(_all_that_apply([(_matches(normalized, p), [name]) for name, p, _ in R.CONCEPTS]))


def _aspect_rows(rows) -> str:
    structs = [
        f"named_struct('id', '{i}', 'query', '{q}', 'keywords', {X.string_array(k)})" for i, q, k in rows
    ]
    return f"array({', '.join(structs)})"


def aspects() -> Column:
    """From ``normalized``, ``identifiers``, ``peripherals`` and ``aliases``; the first case that holds."""
    n = "normalized"
    cases = [
        (f"{_has(n, 'PA9')} and {_has(n, 'USART1_TX')}", _aspect_rows(R.ASPECTS_REMAP)),
        (f"{_has(n, 'ADC')} and {_matches(n, R.SAMPLING)}", _aspect_rows(R.ASPECTS_ADC)),
        (f"{_has(n, 'GPIO')} and {_matches(n, R.MODE_WORDS)}", _aspect_rows(R.ASPECTS_GPIO)),
        (f"array_contains(peripherals, 'TIM') and {_matches(n, R.QUANTITY)}", _aspect_rows(R.ASPECTS_TIMER)),
        (
            "size(peripherals) > 0",
            "array(named_struct('id', concat(lower(get(peripherals, 0)), '-configuration'),"
            " 'query', array_join(concat(identifiers, aliases, peripherals), ' '),"
            " 'keywords', concat(identifiers, peripherals)))",
        ),
    ]
    whens = " ".join(f"when {cond} then {rows}" for cond, rows in cases)
    return F.expr(f"cast(case {whens} else array() end as {ASPECT})")


def variants(
    question: Column,
    chips: Column,
    words: Column,
    ids: Column,
    periphs: Column,
    alias: Column,
    concepts: Column,
    facets: Column,
) -> Column:
    """Weighted query variants; equal texts are merged, keeping the first place and the top weight."""

    def entry(query: Column, weight: float) -> Column:
        return F.struct(X.strip(query).alias("query"), F.lit(weight).alias("weight"))

    by_length = F.array_sort(
        F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    )
    entries = F.filter(
        F.concat(
            F.array(
                entry(question, R.WEIGHT_RAW),
                entry(F.array_join(F.concat(chips, words, ids, periphs, alias), " "), R.WEIGHT_BASE),
                entry(F.array_join(words, " "), R.WEIGHT_KEYWORDS),
                entry(F.array_join(concepts, " "), R.WEIGHT_CONCEPTS),
            ),
            F.transform(F.slice(by_length, 1, 2), lambda s: entry(s["w"], R.WEIGHT_LONGEST)),
            F.transform(facets, lambda a: entry(a["query"], R.WEIGHT_ASPECT)),
        ),
        lambda e: e["query"] != "",
    )
    return X.let(
        entries,
        lambda all_: F.transform(
            F.array_distinct(F.transform(all_, lambda e: e["query"])),
            lambda q: F.struct(
                q.alias("query"),
                F.array_max(
                    F.transform(F.filter(all_, lambda e: e["query"] == q), lambda e: e["weight"])
                ).alias("weight"),
            ),
        ),
    )


def analyze(questions: DataFrame) -> DataFrame:
    """``(query_id, question)`` plus everything the rules derive from the wording."""
    c = F.col
    worded = questions.select(
        "query_id",
        "question",
        X.fold(c("question")).alias("normalized"),
        X.query_keywords(c("question")).alias("keywords"),
    )
    named = worded.select(
        "*",
        F.array_distinct(F.regexp_extract_all("normalized", F.lit(R.CHIP), F.lit(0))).alias("chip_models"),
        identifiers("normalized").alias("identifiers"),
        aliases("question", "normalized").alias("aliases"),
        intent("question").alias("intent"),
        expand_concepts("normalized").alias("concepts"),
    )
    framed = named.withColumn("peripherals", peripherals(F.concat("identifiers", "aliases"))).withColumn(
        "aspects", aspects()
    )
    return framed.withColumn(
        "variants",
        variants(
            c("question"), c("chip_models"), c("keywords"), c("identifiers"),
            c("peripherals"), c("aliases"), c("concepts"), c("aspects"),
        ),
    )


def variant_terms(analysed: DataFrame) -> DataFrame:
    """``(query_id, variant_no, query, weight, terms)``: the terms each variant looks up."""
    v = analysed.select(
        "query_id",
        F.posexplode("variants").alias("variant_no", "variant"),
        F.array_join(F.concat("identifiers", "peripherals", "aliases"), " ").alias("extra"),
    )
    looked_up = X.strip_stopwords(F.concat_ws(" ", F.upper("variant.query"), X.non_empty(F.col("extra"))))
    return v.select(
        "query_id",
        "variant_no",
        F.col("variant.query").alias("query"),
        F.col("variant.weight").alias("weight"),
        X.search_terms(looked_up).alias("terms"),
    )
