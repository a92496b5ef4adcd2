"""Text normalisation, tokenising, n-grams and string similarity."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlane.functions.binding import let
from matchlane.lexicons import STOPWORDS, SYNONYMS

# Characters that survive normalising, and standalone years.
# The explicit look-arounds keep the word boundary Unicode-aware on every JDK.
KEPT = r"a-z0-9+#./\-"
STANDALONE_YEAR = r"\d{4}(?<![\p{L}\p{N}_]\d{4})(?![\p{L}\p{N}_])"


def _without_years(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), STANDALONE_YEAR, " ")


def normalise(text: Column) -> Column:
    """Lower-case, drop standalone years, keep ``[a-z0-9+#./-]``, squeeze spaces."""
    return F.trim(F.regexp_replace(_without_years(F.coalesce(text, F.lit(""))), f"[^{KEPT}]+", " "))


def normalise_literal(text: str) -> str:
    """``normalise`` for lexicon entries (plain ASCII, no years)."""
    return " ".join("".join(ch if ch.isalnum() or ch in "+#./-" else " " for ch in text.lower()).split())


def canonical(token: Column) -> Column:
    """Collapse a token's synonyms.  The hashed ``isin`` keeps the common case cheap."""
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    return F.when(token.isin(list(SYNONYMS)), F.try_element_at(table, token)).otherwise(token)


def tokenize(text: Column, drop_stopwords: bool = True) -> Column:
    """``array<string>`` of canonical tokens.

    One ``regexp_extract_all`` over the kept alphabet gives the same tokens as
    normalising and splitting, in a quarter of the time.
    """
    runs = F.regexp_extract_all(
        _without_years(F.coalesce(text, F.lit(""))), F.lit(f"([{KEPT}]+)"), F.lit(1)
    )
    tokens = F.transform(runs, canonical)
    if drop_stopwords:
        return F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))
    return F.filter(tokens, lambda t: F.length(t) >= 2)


def tokens_set(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the normalised text with spaces shown as ``_``."""
    shown = F.replace(normalise(text), F.lit(" "), F.lit("_"))

    def grams(chars: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(chars) - n)
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))

    return let(
        shown,
        lambda s: F.when(F.length(s) < n, F.array(s)).otherwise(let(characters(s), grams)),
    )


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether some word occurs anywhere in the text (one compiled alternation)."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


# Bits of a word: two words and a carry add up inside a bigint.
WORD_BITS = 62
_ONES = (1 << WORD_BITS) - 1


def _bits_where(chars: Column, wanted: Column) -> Column:
    """The positions of ``wanted`` among up to ``WORD_BITS`` characters as bits of a bigint."""
    one = F.lit(1).cast("bigint")
    bits = F.transform(
        chars, lambda c, i: F.when(c == wanted, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda done, bit: done.bitwiseOR(bit))


def _kept_bits(value: Column, found: Column, carry: Column) -> tuple[Column, Column]:
    """(next word, carry) of one step; ``found`` are the bits of ``value`` that match."""
    total = value + found + carry
    return total.bitwiseOR(value - found).bitwiseAND(F.lit(_ONES)), F.call_function("shiftright", total, F.lit(WORD_BITS))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, bit-parallel.

    A bit per character of ``a`` stands for a step of the dynamic-programming column; each character of
    ``b`` moves all of them with an addition and two logical operations on words of ``WORD_BITS`` bits.
    A cleared bit is one more common character.
    """
    zero = F.lit(0).cast("bigint")

    def in_one_word(x: Column, y: Column) -> Column:
        masks = F.map_from_entries(F.transform(F.array_distinct(x), lambda c: F.struct(c, _bits_where(x, c))))
        met = let(masks, lambda table: F.transform(y, lambda c: F.coalesce(F.try_element_at(table, c), zero)))
        last = F.aggregate(met, F.lit(_ONES), lambda v, m: _kept_bits(v, v.bitwiseAND(m), zero)[0])
        used = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(x)) - 1
        return F.size(x) - F.bit_count(last.bitwiseAND(used))

    def in_words(x: Column, y: Column) -> Column:
        words = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / WORD_BITS).cast("int"))
        parts = F.transform(words, lambda w: F.slice(x, w * WORD_BITS + 1, WORD_BITS))
        masks = F.map_from_entries(
            F.transform(
                F.array_distinct(x), lambda c: F.struct(c, F.transform(parts, lambda part: _bits_where(part, c)))
            )
        )
        met = let(masks, lambda table: F.filter(F.transform(y, lambda c: F.try_element_at(table, c)), lambda m: m.isNotNull()))

        def step(state: Column, mask: Column) -> Column:
            def word(done: Column, w: Column) -> Column:
                value = F.get(state, w)
                kept, carry = _kept_bits(value, value.bitwiseAND(F.get(mask, w)), done["carry"])
                return F.struct(F.concat(done["words"], F.array(kept)).alias("words"), carry.alias("carry"))

            empty = F.struct(F.array().cast("array<bigint>").alias("words"), zero.alias("carry"))
            return F.aggregate(words, empty, word, lambda done: done["words"])

        last = F.aggregate(met, F.transform(words, lambda w: F.lit(_ONES)), step)
        unused = F.size(words) * WORD_BITS - F.size(x)  # bits of the last word that stand for nothing stay set
        left = F.aggregate(last, F.lit(0), lambda n, v: n + F.bit_count(v))
        return F.size(x) - (left - unused)

    def table(s: Column) -> Column:
        fits = F.size(s["a"]) <= WORD_BITS
        return F.when(F.size(s["a"]) == 0, 0).when(fits, in_one_word(s["a"], s["b"])).otherwise(in_words(s["a"], s["b"]))

    return let(F.struct(characters(a).alias("a"), characters(b).alias("b")), table)


def indel_ratio(a: Column, b: Column) -> Column:
    """``100 * 2 * LCS / (|a| + |b|)`` — an insert/delete similarity, not Levenshtein."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)
