"""Scalar functions on words as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consonant classes and suffix lists of the Latin side.
LATIN_CLASSES = {
    "c": "K", "k": "K", "q": "K", "g": "K",
    "t": "T", "d": "T",
    "p": "P", "b": "P", "v": "P", "f": "P",
    "s": "S", "z": "S", "x": "S",
    "l": "L", "r": "R", "m": "M", "n": "N",
}
# Consonant classes of the cipher side; two signs go before one (three never come to be asked).
CIPHER_CLASSES = {
    "k": "K", "t": "T", "p": "P", "f": "P",
    "ch": "K", "c": "K", "sh": "S", "s": "S",
    "l": "L", "r": "R", "m": "M", "n": "N", "in": "N",
    "d": "T", "ck": "K", "ct": "T",
}
# Inflections that the stemmer strips, in order.
STEM_SUFFIXES = [
    "ibus", "arum", "orum", "ione", "onis", "inem", "atis", "atus", "endo", "ando",
    "um", "am", "em", "is", "ae", "os", "as", "es", "us", "im", "ui", "ei", "ii", "io",
    "i", "a", "e", "o",
]
# Affixes of the morphology parser, in order.
PARSE_PREFIXES = ["con", "per", "sub", "pro", "in", "ex", "de", "ad", "re"]
PARSE_SUFFIXES = [
    "ibus", "arum", "orum", "atum", "ium", "ius", "bus", "que",
    "am", "em", "um", "os", "as", "es", "is", "us", "ae", "oe",
    "a", "e", "i", "o", "u", "m", "s", "t",
]
# Closed word classes and endings of the tagger.
PREPOSITIONS = [
    "in", "cum", "per", "ad", "de", "pro", "contra", "sub", "super", "ex", "ab", "sine", "inter", "ante", "post",
    "apud", "circa", "praeter", "propter", "trans", "ultra", "infra", "supra",
]
CONJUNCTIONS = [
    "et", "sed", "aut", "vel", "atque", "nec", "neque", "quod", "quia", "nam", "enim", "ergo", "igitur", "tamen",
    "autem", "sive", "seu", "ac", "nisi", "si", "quam", "ut", "sicut",
]
ADVERBS = [
    "bene", "male", "valde", "satis", "nimis", "semper", "numquam", "tunc", "inde", "ibi", "ubi", "non", "iam",
    "adhuc", "item", "similiter", "maxime", "optime", "melius", "fortiter", "statim",
]
DETERMINERS = [
    "hic", "haec", "hoc", "ille", "illa", "illud", "iste", "ista", "istud", "qui", "quae", "quod", "is", "ea", "id",
    "idem", "eadem", "omnis", "omne", "omnia", "totus", "tota", "totum", "nullus", "nulla", "nullum", "alius", "alia",
    "aliud", "quidam", "quaedam", "quoddam", "aliquis", "aliqua", "aliquod",
]
# Endings of two classes; those that end in another one of the list are left out, as they add nothing.
VERB_ENDINGS = ["at", "et", "it", "ut", "nt", "atur", "etur", "itur", "are", "ere", "ire", "ari", "eri", "iri", "antur", "entur", "untur"]
ADJECTIVE_ENDINGS = ["us", "a", "um", "is", "e", "em", "am", "ior", "ius"]
# What a cipher suffix says of its word.
SUFFIX_TAGS = {
    "iin": "VERB_3P", "in": "NOUN_ACC", "dy": "NOUN_FEM", "ey": "NOUN_NOM", "y": "ADJ",
    "l": "NOUN", "r": "NOUN_AGT", "m": "NOUN_ACC", "s": "NOUN_PL",
}
# Two alphabets for writing words anew; ``rewrite`` takes the longest sign group first, whatever the order here.
SIGN_GROUPS = {"sh": "S", "ch": "C", "cth": "U", "ckh": "V", "cph": "W", "cfh": "X", "ii": "J", "iii": "Z", "qo": "Q", "ee": "E"}
SIGN_ROLES = {
    "k": "G", "t": "G", "p": "G", "f": "G", "ch": "B", "sh": "B", "ol": "L", "or": "L", "al": "L", "ar": "L",
    "ii": "I", "iii": "I", "iiii": "I",
}


def skeleton(word: Column) -> Column:
    """Consonant classes in order, equal neighbours one even across vowels, joined by '-'."""
    kept = F.regexp_replace(F.translate(F.lower(word), "".join(LATIN_CLASSES), "".join(LATIN_CLASSES.values())), "[^A-Z]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"(.)\1+", "$1"), "(?<=.)(?=.)", "-")


def vowel_skeleton(word: Column) -> Column:
    """As ``skeleton``, with V for every other letter; classes collapse only where no vowel stands between."""
    mapped = F.translate(F.lower(word), "".join(LATIN_CLASSES), "".join(LATIN_CLASSES.values()))
    mapped = F.regexp_replace(mapped, "[^A-Z]", "v")
    mapped = F.upper(F.regexp_replace(mapped, r"([A-Z])\1+", "$1"))
    return F.regexp_replace(mapped, "(?<=.)(?=.)", "-")


def cipher_skeleton(word: Column) -> Column:
    """Classes of the cipher side: two-sign keys first, nothing collapsed."""
    pairs = [k for k in CIPHER_CLASSES if len(k) == 2]
    # one pass from the left: a pair, else a sign; anything else is dropped
    out = F.regexp_extract_all(word, F.lit("(" + "|".join(pairs) + "|[a-z])"), 1)
    classes = F.create_map(*(F.lit(x) for k, v in CIPHER_CLASSES.items() for x in (k, v)))
    return F.array_join(F.filter(F.transform(out, lambda s: classes[s]), lambda s: s.isNotNull()), "-")


def segments(skel: Column) -> Column:
    return F.when(skel == "", 0).otherwise(F.size(F.split(skel, "-")))


def fuzzy_reach(skel: Column) -> Column:
    """Edit distance that a skeleton may be matched at: 0 up to four segments, 1 beyond."""
    return F.when(segments(skel) <= 4, 0).otherwise(1)


def stem(word: Column) -> Column:
    """The first suffix of the list that leaves three letters goes."""
    return reduce(
        lambda rest, s: F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(rest),
        reversed(STEM_SUFFIXES),
        word,
    )


def _first_affix(word: Column, affixes: list[str], at_end: bool) -> Column:
    has = (lambda a: word.endswith(a)) if at_end else (lambda a: word.startswith(a))
    return reduce(lambda rest, a: F.when(has(a) & (F.length(word) > len(a) + 2), F.lit(a)).otherwise(rest), reversed(affixes), F.lit(""))


def parse_prefix(word: Column) -> Column:
    return _first_affix(word, PARSE_PREFIXES, False)


def parse_suffix(rest: Column) -> Column:
    return _first_affix(rest, PARSE_SUFFIXES, True)


def pos_tag(word: Column) -> Column:
    """Closed classes, then verb endings, then adjective endings, else NOUN; empty is OTHER."""
    ends = lambda xs: F.regexp_like(word, F.lit("(" + "|".join(xs) + ")$"))
    long = F.length(word) > 3
    return (
        F.when(word == "", "OTHER")
        .when(word.isin(PREPOSITIONS), "PREP")
        .when(word.isin(CONJUNCTIONS), "CONJ")
        .when(word.isin(ADVERBS), "ADV")
        .when(word.isin(DETERMINERS), "DET")
        .when(long & ends(VERB_ENDINGS), "VERB")
        .when(long & ends(ADJECTIVE_ENDINGS), "ADJ")
        .otherwise("NOUN")
    )


def suffix_tag(word: Column) -> Column:
    """Tag of the longest known suffix that leaves a stem, else UNK."""
    by_length = sorted(SUFFIX_TAGS, key=lambda s: -len(s))
    return reduce(
        lambda rest, s: F.when(word.endswith(s) & (F.length(word) > len(s)), SUFFIX_TAGS[s]).otherwise(rest), reversed(by_length), F.lit("UNK")
    )


def pattern_signature(word: Column) -> Column:
    """Letters renamed A, B, ... in the order they first come: words of one signature are isomorphs."""
    chars = F.split(word, "")
    names = F.transform(chars, lambda c: F.char(F.lit(64) + F.array_position(F.array_distinct(chars), c)))
    return F.array_join(names, "")


def rewrite(word: Column, alphabet: dict[str, str]) -> Column:
    """Each source sign group becomes its sign, longest first; what is written once is not read again."""
    order = sorted(alphabet, key=lambda s: -len(s))
    return reduce(lambda w, s: F.regexp_replace(w, s, alphabet[s]), order, word)


def syllables(word: Column) -> Column:
    """Every vowel ends a syllable; letters after the last vowel join the last syllable."""
    opened = F.regexp_extract_all(F.lower(word), F.lit("([^aeiouy]*[aeiouy])"), 1)
    tail = F.regexp_extract(F.lower(word), "([^aeiouy]*)$", 1)
    n = F.size(opened)
    closed = F.concat(F.slice(opened, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(opened, -1), tail)))
    return F.when(n > 0, closed).otherwise(F.array(F.lower(word)))


def syllable_parts(syllable: Column) -> Column:
    """(onset, nucleus, coda): consonants with qu as one, a vowel or a diphthong, the rest."""
    rx = "^((?:[^aeiouyq]*qu)|[^aeiouy]*)((?:ae|oe|au|eu)|[aeiouy]?)(.*)$"
    return F.struct(*(F.regexp_extract(syllable, rx, i).alias(n) for i, n in ((1, "onset"), (2, "nucleus"), (3, "coda"))))


def synthesize(stem_: Column, suffix: Column) -> Column:
    """A stem with a suffix by the rules of vowel contact."""
    last, first = F.right(stem_, F.lit(1)), F.left(suffix, F.lit(1))
    cut = F.concat(F.substring(stem_, F.lit(1), F.length(stem_) - 1), suffix)
    return (
        F.when((stem_ == "") | (suffix == ""), stem_)
        .when((last == "e") & (first == "e"), cut)
        .when((last == "a") & (suffix == "a"), stem_)
        .when((last == "i") & (first == "i"), cut)
        .when((suffix == "t") & ~last.isin("a", "e", "i", "o", "u"), F.concat(stem_, F.lit("it")))
        .otherwise(F.concat(stem_, suffix))
    )
