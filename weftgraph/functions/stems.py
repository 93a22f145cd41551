"""English stems by Porter's rules, as column expressions and as the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs of consonants and of vowels; y is a vowel after a consonant. A word is [C](VC){m}[V].
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0 = f"^(?:{_C})?{_V}{_C}"  # m > 0
_M1 = f"^(?:{_C})?(?:{_V}{_C}){{2}}"  # m > 1
_IS1 = f"^(?:{_C})?{_V}{_C}(?:{_V})?$"  # m = 1
_VOWEL = f"^(?:{_C})?[aeiouy]"
_CVC = f"^{_C}[aeiouy][^aeiouwxy]$"

#: Endings and what takes their place, by step; the longest that fits decides. Fixed values.
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


class _Spark:
    """How a rule is written as a column."""

    like = staticmethod(lambda c, p: c.rlike(p))
    ends = staticmethod(lambda c, s: c.endswith(s))
    head = staticmethod(lambda c, n: F.substring(c, F.lit(1), F.length(c) - n))
    joined = staticmethod(lambda c, s: F.concat(c, F.lit(s)) if s else c)
    both = staticmethod(lambda p, q: p & q)
    no = staticmethod(lambda p: ~p)

    @staticmethod
    def case(ways: list, other):
        out = None
        for when, then in ways:
            out = F.when(when, then) if out is None else out.when(when, then)
        return out.otherwise(other)


class _Sql:
    """How a rule is written in SQL over the same names."""

    like = staticmethod(lambda c, p: f"regexp_matches({c}, '{p}')")
    ends = staticmethod(lambda c, s: f"ends_with({c}, '{s}')")
    head = staticmethod(lambda c, n: f"left({c}, length({c}) - {n})")
    joined = staticmethod(lambda c, s: f"{c} || '{s}'" if s else c)
    both = staticmethod(lambda p, q: f"({p} AND {q})")
    no = staticmethod(lambda p: f"NOT {p}")

    @staticmethod
    def case(ways: list, other):
        return f"CASE {' '.join(f'WHEN {p} THEN {v}' for p, v in ways)} ELSE {other} END"


def _steps(s) -> list:
    """The steps in order, in the way of ``s``; each takes a word to what it becomes."""
    cut = lambda c, end: s.head(c, len(end))

    def ladder(c, endings: dict[str, str], least: str):
        """The longest ending of the word is taken, if what is left of the word has the measure."""
        return s.case([(s.ends(c, end), s.case([(s.like(cut(c, end), least), s.joined(cut(c, end), new))], c)) for end, new in sorted(endings.items(), key=lambda e: -len(e[0]))], c)

    def plural(c):
        return s.case([(s.ends(c, "sses"), cut(c, "es")), (s.ends(c, "ies"), cut(c, "es")), (s.ends(c, "ss"), c), (s.ends(c, "s"), cut(c, "s"))], c)

    def past(c):
        """Cuts ed and ing; a mark says that something was cut, and the next step mends what is left."""
        gone = lambda end: s.both(s.ends(c, end), s.like(cut(c, end), _VOWEL))
        return s.case([(s.ends(c, "eed"), s.case([(s.like(cut(c, "eed"), _M0), cut(c, "d"))], c)), (gone("ed"), s.joined(cut(c, "ed"), "+")), (gone("ing"), s.joined(cut(c, "ing"), "+"))], c)

    def mended(c):
        b = cut(c, "+")
        double = f"({'|'.join(x + x for x in 'bcdfghjkmnpqrtvwxy')})$"  # but not ll, ss and zz
        ways = [(s.like(b, "(at|bl|iz)$"), s.joined(b, "e")), (s.like(b, double), s.head(b, 1)), (s.both(s.like(b, _IS1), s.like(b, _CVC)), s.joined(b, "e"))]
        return s.case([(s.no(s.ends(c, "+")), c), *ways], b)

    def final_y(c):
        return s.case([(s.both(s.ends(c, "y"), s.like(cut(c, "y"), _VOWEL)), s.joined(cut(c, "y"), "i"))], c)

    def last(c):
        ways = [(s.ends(c, end), s.case([(s.like(cut(c, end), _M1), cut(c, end))], c)) for end in sorted(LAST, key=len, reverse=True)]
        return s.case([*ways, (s.like(c, "[st]ion$"), s.case([(s.like(cut(c, "ion"), _M1), cut(c, "ion"))], c))], c)

    def final_e(c):
        b = cut(c, "e")
        short = s.both(s.like(b, _IS1), s.no(s.like(b, _CVC)))
        return s.case([(s.both(s.ends(c, "e"), s.like(b, _M1)), b), (s.both(s.ends(c, "e"), short), b)], c)

    def final_l(c):
        return s.case([(s.both(s.ends(c, "ll"), s.like(s.head(c, 1), _M1)), s.head(c, 1))], c)

    return [plural, past, mended, final_y, lambda c: ladder(c, DOUBLE, _M0), lambda c: ladder(c, SINGLE, _M0), last, final_e, final_l]


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of two letters or fewer, and those with others than a to z, stay.

    Steps are bound one after the other by a one-element ``transform``, so that no expression is repeated in the next.
    """
    out = F.array(word)
    for step in _steps(_Spark):
        out = F.transform(out, step)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), F.element_at(out, 1)).otherwise(word)


def stem_sql(source: str, word: str = "word") -> str:
    """A query of (word, stem) over the distinct words of a table."""
    inner = f"SELECT DISTINCT {word} AS word, {word} AS w FROM {source} WHERE length({word}) > 2 AND regexp_matches({word}, '^[a-z]+$')"
    for step in _steps(_Sql):
        inner = f"SELECT word, {step('w')} AS w FROM ({inner})"
    return f"SELECT word, w AS stem FROM ({inner}) UNION ALL SELECT DISTINCT {word}, {word} FROM {source} WHERE NOT (length({word}) > 2 AND regexp_matches({word}, '^[a-z]+$'))"
