"""Text expressions: normalizers, masks, phrases, tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import vocab


def singular(token: Column) -> Column:
    length = F.length(token)
    out = F.when(
        (length <= 3) | token.rlike("(ss|us|is)$") | token.isin(*vocab.UNINFLECTED), token
    )
    for plural, single in vocab.IRREGULAR_SINGULARS.items():
        out = out.when(token == plural, F.lit(single))
    return (out.when(token.endswith("ies") & (length > 4), F.concat(_drop(token, 3), F.lit("y")))
            .when(token.rlike("(ches|shes|xes|zes)$"), _drop(token, 2))
            .when(token.endswith("s"), _drop(token, 1))
            .otherwise(token))


def _drop(token: Column, n: int) -> Column:
    return F.substring(token, F.lit(1), F.length(token) - n)


def plain_words(c: Column) -> Column:
    """Lower case, everything but letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]+", " "))


def normalize_ingredient(c: Column) -> Column:
    text = F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    words = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.transform(words, singular), " ")


def normalize_text(c: Column, keep_hyphen: bool = True) -> Column:
    """Feature text keeps hyphens; without `keep_hyphen` both & and - become spaces."""
    if not keep_hyphen:
        return plain_words(c)
    text = F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, "[^a-z0-9-]+", " "))


def mask_phrases(normalized: Column, phrases=vocab.MASK_PHRASES) -> Column:
    """Remove bounded phrases one after the other; a removed phrase consumes its spaces."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    for phrase in phrases:
        padded = F.replace(padded, F.lit(f" {phrase} "), F.lit(" "))
    return F.trim(F.regexp_replace(padded, " +", " "))


def has_phrase(normalized: Column, phrase) -> Column:
    """Token-bounded, directional containment."""
    needle = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def any_substring(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def ngrams(tokens: str, longest: str) -> Column:
    """All phrases of up to `longest` tokens; both arguments are column names."""
    return F.expr(
        f"array_distinct(flatten(transform(sequence(1, greatest(1, {longest})), k -> transform("
        f"filter(sequence(1, greatest(1, size({tokens}))), i -> i + k - 1 <= size({tokens})), "
        f"i -> array_join(slice({tokens}, i, k), ' ')))))"
    )


def ingredient_texts(c: Column) -> Column:
    """Trimmed, non-blank ingredients; null gives an empty array."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)),
                    lambda x: x != "")


def split_personal(c: Column) -> Column:
    parts = F.split(F.coalesce(c, F.lit("")), r"[\r\n,]")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def format_name(c: Column) -> Column:
    words = F.filter(F.split(normalize_text(c), " "), lambda x: x != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) <= 2, F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")


def title_case(c: Column) -> Column:
    """Capitalise the first letter after every non-letter, as in a book title."""
    low = F.lower(c)
    chars = F.split(low, "")
    return F.array_join(F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(ch)).otherwise(ch)), "")


def content_tokens(c: Column, stop_words=vocab.CONTENT_STOP_WORDS) -> Column:
    # The words of `normalize_text` with hyphens as blanks, cut in one pass.
    text = F.replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit("&"), F.lit(" and "))
    words = F.split(text, "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def keyword_prior(normalized: Column, keywords=None, default: float = vocab.KEYWORD_DEFAULT) -> Column:
    """Score of the first keyword, in declared order, contained as a phrase.

    Phrase containment normalizes both sides, so plural keywords are made singular here too.
    """
    keywords = vocab.KEYWORD_PRIORS if keywords is None else keywords
    out = None
    for word, score in keywords.items():
        hit = has_phrase(normalized, normalize_ingredient(F.lit(word)))
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def generation_name(base: Column, trained_at: Column) -> Column:
    return F.concat(F.trim(base), F.lit("@"), F.regexp_replace(trained_at, r"[^\p{L}\p{N}]", ""))


def unit_family(c: Column) -> Column:
    unit = normalize_ingredient(c)
    out = F.when(unit == "", F.lit("unknown"))
    for family, names in vocab.UNIT_FAMILIES.items():
        out = out.when(unit.isin(*names), F.lit(family))
    return out.otherwise(F.lit("other"))


def image_signature(url: Column) -> Column:
    photo = F.lower(F.regexp_extract(url, r"(?i)photo-[a-z0-9-]+", 0))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return (F.when(photo != "", photo)
            .when(host != "", F.lower(F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))))
            .otherwise(F.lower(F.split(url, r"\?")[0])))


def blocked_image_url(url: Column, terms=vocab.NON_FOOD_URL_TERMS, signatures=vocab.BLOCKED_SIGNATURES) -> Column:
    plain = F.lower(F.coalesce(F.try_url_decode(url), url))
    words = "|".join(terms)
    hit = plain.rlike(f"(^|[^a-z0-9])({words})([^a-z0-9]|$)") | image_signature(url).isin(*signatures)
    return F.coalesce(hit, F.lit(False))
