"""Analyzers and full-text matching as column expressions over arrays of tokens, and a relevance score."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The English stop words of the stemmer and ngram analyzers.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
SATURATION = 1.2


def standard(c: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def whitespace(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def keyword(c: Column) -> Column:
    return F.array(c)


def filename(c: Column) -> Column:
    """One token, lower case, of any length."""
    return F.array(F.lower(c))


def _without_stops(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOP_WORDS))


# Fixed values of the English stemming algorithm (Snowball): suffixes of each step and what they become, words with stems of their own.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = "inning outing canning herring earring proceed exceed succeed".split()
VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
SHORT = f"(?:(?:^|{OTHER}){VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _stems(tokens: Column) -> Column:
    """The English stems of tokens. A token goes through as a struct of word and regions r1, r2; every transform binds it for its step."""

    def state(w: Column, x: Column | None = None, **more: Column) -> Column:
        return F.struct(w.alias("w"), *[(more[k] if k in more else x[k]).alias(k) for k in ("r1", "r2", "t")])

    def suffix(x: Column, endings) -> Column:
        return F.regexp_extract(x["w"], f"({'|'.join(endings)})$", 1)

    def without(x: Column, n) -> Column:
        return F.substring(x["w"], F.lit(1), F.char_length(x["w"]) - (n if isinstance(n, int) else F.char_length(n)))

    def inside(x: Column, end: Column, region: str) -> Column:
        return (end != "") & (F.char_length(x["w"]) - F.char_length(end) >= x[region])

    def regions(t: Column) -> Column:
        w = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^'", ""), "^y", "Y"), "(?<=[aeiouy])y", "Y")
        return F.struct(w.alias("w"), t.alias("t"))

    def first(x: Column) -> Column:
        start = F.char_length(F.regexp_extract(x["w"], f"^(?:gener|commun|arsen|.*?{VOWEL}{OTHER})", 0))
        return F.struct(x["w"].alias("w"), F.when(start > 0, start).otherwise(F.char_length(x["w"])).alias("r1"), x["t"].alias("t"))

    def second(x: Column) -> Column:
        rest = F.char_length(F.regexp_extract(F.substring(x["w"], x["r1"] + 1, F.char_length(x["w"])), f"^.*?{VOWEL}{OTHER}", 0))
        return state(x["w"], x, r2=F.when(rest > 0, x["r1"] + rest).otherwise(F.char_length(x["w"])))

    def step_0(x: Column) -> Column:
        return state(F.regexp_replace(x["w"], "'(?:s'?)?$", ""), x)

    def step_1a(x: Column) -> Column:
        w, end = x["w"], suffix(x, ("sses", "ied", "ies", "us", "ss", "s"))
        long = F.char_length(w) > 4
        out = (
            F.when(end == "sses", without(x, 2)).when(end.isin("ied", "ies"), F.when(long, without(x, 2)).otherwise(without(x, 1)))
            .when((end == "s") & w.rlike(f"{VOWEL}.+s$"), without(x, 1)).otherwise(w)
        )
        return state(out, x)

    def step_1b(x: Column) -> Column:
        w, end = x["w"], suffix(x, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
        bare = without(x, end)
        short = bare.rlike(SHORT) & (F.char_length(bare) <= x["r1"])
        mended = (
            F.when(bare.rlike("(?:at|bl|iz)$"), F.concat(bare, F.lit("e"))).when(bare.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.substring(bare, F.lit(1), F.char_length(bare) - 1))
            .when(short, F.concat(bare, F.lit("e"))).otherwise(bare)
        )
        eed = F.when(inside(x, end, "r1"), F.concat(bare, F.lit("ee"))).otherwise(w)
        out = F.when(w.isin(KEPT_AFTER_PLURALS), w).when(end.isin("eed", "eedly"), eed).when((end != "") & bare.rlike(VOWEL), mended).otherwise(w)
        return state(out, x)

    def step_1c(x: Column) -> Column:
        return state(F.when(x["w"].isin(KEPT_AFTER_PLURALS), x["w"]).otherwise(F.regexp_replace(x["w"], f"(?<=.{OTHER})[yY]$", "i")), x)

    def mapped(x: Column, table: dict[str, str], tests: dict) -> Column:
        end = suffix(x, table)
        out = F.lit(None).cast("string")
        for s, to in table.items():
            allowed = tests.get(s, lambda bare: F.lit(True))
            out = F.when(end == s, F.when(inside(x, end, "r1") & allowed(without(x, len(s))), F.concat(without(x, len(s)), F.lit(to)))).otherwise(out)
        return state(F.coalesce(out, x["w"]), x)

    def step_2(x: Column) -> Column:
        return mapped(x, STEP_2, {"ogi": lambda bare: bare.rlike("l$"), "li": lambda bare: bare.rlike("[cdeghkmnrt]$")})

    def step_3(x: Column) -> Column:
        return mapped(x, STEP_3, {"ative": lambda bare: F.char_length(bare) >= x["r2"]})

    def step_4(x: Column) -> Column:
        end = suffix(x, STEP_4)
        go = inside(x, end, "r2") & ((end != "ion") | without(x, 3).rlike("[st]$"))
        return state(F.when(go, without(x, end)).otherwise(x["w"]), x)

    def step_5(x: Column) -> Column:
        w, end = x["w"], F.substring(x["w"], -1, 1)
        e = (end == "e") & (inside(x, end, "r2") | (inside(x, end, "r1") & ~without(x, 1).rlike(SHORT)))
        ll = (end == "l") & inside(x, end, "r2") & w.rlike("ll$")
        return state(F.when(e | ll, without(x, 1)).otherwise(w), x)

    def finish(x: Column) -> Column:
        out = F.when(F.char_length(x["t"]) <= 2, x["t"]).otherwise(F.regexp_replace(x["w"], "Y", "y"))
        return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in OWN_STEMS.items() for v in pair]), x["t"]), out)

    for step in (regions, first, second, step_0, step_1a, step_1b, step_1c, step_2, step_3, step_4, step_5, finish):
        tokens = F.transform(tokens, step)
    return tokens


def stem(t: Column) -> Column:
    return F.get(_stems(F.array(t)), 0)


def stemmer(c: Column) -> Column:
    return _stems(_without_stops(standard(c)))


def ngram(c: Column, n: int = 3) -> Column:
    """Character trigrams of the lower-cased value."""
    low = F.lower(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, n))
    return _without_stops(F.filter(grams, lambda g: F.char_length(g) == n))


def lowercase(c: Column) -> Column:
    """The normalizer: one token, lower case."""
    return F.array(F.lower(c))


ANALYZERS = {"standard": standard, "simple": standard, "whitespace": whitespace, "keyword": keyword, "stemmer": stemmer, "ngram": ngram, "filename": filename, "lowercase": lowercase}


def analyze_words(text: str, analyzer: str) -> list[str]:
    """The plain words of a query string; case and stems follow in the column expression of the same analyzer."""
    if analyzer in ("keyword", "lowercase", "filename"):
        return [text if analyzer == "keyword" else text.lower()]
    if analyzer == "whitespace":
        return text.split()
    words = [w for w in re.split(r"[^\w*?]+", text.lower()) if w]
    return [w for w in words if w not in STOP_WORDS] if analyzer in ("stemmer", "ngram") else words


@lru_cache(maxsize=10_000)
def stem_of(word: str) -> str:
    """The stem of a query's word, by the same expression over a local row, which the optimizer evaluates without a job."""
    row = SparkSession.active().sql("SELECT col1 AS w FROM VALUES (:w)", args={"w": word})
    return row.select(stem(F.col("w")).alias("stem")).first()["stem"]


def query_token(word: str, analyzer: str) -> Column:
    return F.lit(stem_of(word) if analyzer == "stemmer" else word)


def wildcard(pattern: str) -> str:
    """An anchored regular expression of a pattern with * and ?."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"


def count_matching(tokens: Column, matches) -> Column:
    return F.size(F.filter(tokens, matches))


def term_count(tokens: Column, word: str, analyzer: str, edits: int | None = None) -> Column:
    """How many tokens match one query word: equal, by wildcard, or within so many edits."""
    if "*" in word or "?" in word:
        pattern = wildcard(word)
        return count_matching(tokens, lambda t: t.rlike(pattern))
    if analyzer == "ngram" and len(word) > 3:
        grams = [word[i : i + 3] for i in range(len(word) - 2)]
        return F.when(F.size(F.array_intersect(tokens, F.array(*map(F.lit, grams)))) > 0, 1).otherwise(0)
    goal = query_token(word, analyzer)
    if edits:
        return count_matching(tokens, lambda t: F.levenshtein(t, goal, edits) >= 0)
    return count_matching(tokens, lambda t: t == goal)


def phrase_count(tokens: Column, words: list[str], analyzer: str, slop: int = 0) -> Column:
    """Starts of the phrase: every word at its place, up to slop positions later than the one before it requires."""
    goals = [query_token(w, analyzer) for w in words]

    def found(i: Column, k: int) -> Column:
        # word k stands at i; the next within slop + 1 positions
        here = F.get(tokens, i) == goals[k]
        if k + 1 == len(goals):
            return here
        steps = range(1, slop + 2)
        later = found(i + 1, k + 1)
        for step in list(steps)[1:]:
            later = later | found(i + step, k + 1)
        return here & later

    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda i: F.coalesce(found(i, 0), F.lit(False))))


def saturated(count: Column) -> Column:
    """A term's part of the score: grows with its frequency towards 1 + SATURATION."""
    n = F.coalesce(count, F.lit(0)).cast("double")
    return n * (SATURATION + 1) / (n + SATURATION)
