"""Edit-distance matching where swapping two neighbouring letters counts as one edit.

The native ``levenshtein`` knows no swaps, so swaps are spelled out on the query side: a term
is within ``k`` edits of a word when it is within ``k`` plain edits, or within the remaining
edits of one of the word's swapped spellings. For a literal word those spellings are Python
constants, and the whole test is one generated-code filter over the term column.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from litsearch.session import fan_out

Fuzziness = str | int

# Terms and words share a deletion variant of their first PREFIX letters whenever they are
# within two edits, so longer words need no more variants than short ones.
PREFIX = 8


def query_words(text: str) -> list[str]:
    """Words of a query string, lower-cased, in order, the way fields are tokenised."""
    return [w for w in re.findall(r"\w+", text.lower())]


def _fixed_edits(fuzziness: Fuzziness) -> int:
    if int(fuzziness) not in (0, 1, 2):
        raise ValueError(f"at most two edits are supported, got {fuzziness}")
    return int(fuzziness)


def allowed_edits(word: str, fuzziness: Fuzziness = "AUTO") -> int:
    if fuzziness != "AUTO":
        return _fixed_edits(fuzziness)
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def allowed_edits_col(word: Column, fuzziness: Fuzziness = "AUTO") -> Column:
    if fuzziness != "AUTO":
        return F.lit(_fixed_edits(fuzziness))
    n = F.length(word)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def _swaps(word: str) -> list[str]:
    out = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return sorted(out - {word})


def _swaps_around_a_dropped_letter(word: str) -> list[str]:
    return sorted({word[:i] + word[i + 2] + word[i] + word[i + 3 :] for i in range(len(word) - 2)})


def matches_word(term: Column, word: str, k: int) -> Column:
    """``term`` is within ``k`` (0, 1 or 2) edits of the literal ``word``."""
    if k == 0:
        return term == F.lit(word)
    if k not in (1, 2):
        raise ValueError(f"at most two edits are supported, got {k}")

    def within(target: str, edits: int) -> Column:
        return F.levenshtein(term, F.lit(target), edits) >= 0  # -1 beyond the limit

    near = F.length(term).between(len(word) - k, len(word) + k)
    swapped = _swaps(word)
    tests = [within(word, k)]
    if k == 1:
        spellings = swapped
    else:
        near &= within(word, 4)  # a swap is two plain edits, so this settles most terms at once
        tests += [within(s, 1) for s in swapped]
        twice = {t for s in swapped for t in _swaps(s)}
        spellings = sorted(twice.union(_swaps_around_a_dropped_letter(word)))
    if spellings:
        tests.insert(1, term.isin(spellings))
    return near & reduce(lambda a, b: a | b, tests)


def _swaps_col(w: Column) -> Column:
    n = F.length(w)
    at = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at,
        lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(1)),
            F.substring(w, i, F.lit(1)), F.substring(w, i + 2, n),
        ),
    )


def _swaps_around_a_dropped_letter_col(w: Column) -> Column:
    n = F.length(w)
    at = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at,
        lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 2, F.lit(1)),
            F.substring(w, i, F.lit(1)), F.substring(w, i + 3, n),
        ),
    )


def _letters(w: Column) -> Column:
    return F.array_join(F.sort_array(F.split(w, "")), "")


def fuzzy_match(term: Column, word: Column, k: Column) -> Column:
    """Column form of :func:`matches_word`, for pairs found by a join.

    Most pairs are settled by the plain distance. Spellings with swaps are made only for pairs
    that could differ by one: a swap is two plain edits and leaves the letters as they are.
    """
    near = F.abs(F.length(term) - F.length(word)) <= k
    distance = F.levenshtein(term, word, 4)
    plain = distance.between(F.lit(0), k)
    maybe_swapped = distance.between(k + 1, 2 * k) & F.levenshtein(
        _letters(term), _letters(word), 2
    ).between(F.lit(0), 2 * (k - 1))
    swapped = _swaps_col(word)
    one = (k >= 1) & F.array_contains(swapped, term)
    two = (k >= 2) & (
        F.exists(swapped, lambda s: F.levenshtein(s, term, 1) >= 0)
        | F.exists(swapped, lambda s: F.array_contains(_swaps_col(s), term))
        | F.array_contains(_swaps_around_a_dropped_letter_col(word), term)
    )
    return F.when(near & plain, True).when(near & maybe_swapped, one | two).otherwise(False)


def _drop_one(w: Column) -> Column:
    n = F.length(w)
    at = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))


def deletion_variants(word: Column, k: Column) -> Column:
    """The first ``PREFIX`` letters with up to ``k`` letters left out (at most 37 variants)."""
    head = F.substring(word, 1, PREFIX)
    none = F.array().cast("array<string>")
    once = _drop_one(head)
    return F.array_distinct(
        F.concat(
            F.array(head),
            F.when(k >= 1, once).otherwise(none),
            F.when(k >= 2, F.flatten(F.transform(once, _drop_one))).otherwise(none),
        )
    )


def similar_terms(
    words: DataFrame, vocabulary: DataFrame, fuzziness: Fuzziness = "AUTO",
    word: str = "word", term: str = "term",
) -> DataFrame:
    """Every (word, term) pair within the allowed edits, without comparing all pairs.

    Both sides are expanded into deletion variants and met by an equality join; any two words
    within ``k`` edits share a variant, so nothing is lost. The exact test follows the join.
    ``words`` and ``vocabulary`` should hold distinct values.
    """
    n = F.length(term)
    if fuzziness == "AUTO":
        # two edits are allowed from six letters on, so they reach terms of four letters or more
        reach = F.when(n <= 1, 0).when(n <= 3, 1).otherwise(2)
    else:
        reach = F.lit(int(fuzziness))
    vocabulary = fan_out(vocabulary.select(term))
    left = words.select(word, allowed_edits_col(F.col(word), fuzziness).alias("_k")).select(
        word, "_k", F.explode(deletion_variants(F.col(word), F.col("_k"))).alias("_variant")
    )
    right = vocabulary.select(term, F.explode(deletion_variants(F.col(term), reach)).alias("_variant"))
    close = F.abs(F.length(term) - F.length(word)) <= F.col("_k")
    return (
        left.join(right, "_variant").filter(close).select(word, term, "_k").distinct()
        .filter(fuzzy_match(F.col(term), F.col(word), F.col("_k")))
        .select(word, term)
    )
