"""Text expressions on columns, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no weight in search.
STOP_WORDS = (
    "a an and are as at be but by for from has have if in into is it its of on or that the then this to was were will "
    "with you your we our not can const let var function return import export default class new null true false "
    "undefined type interface public private static void string number boolean"
).split()


def tokens(text: Column, stop_words: bool = True) -> Column:
    """Lower-case search tokens in order, repeats kept.

    ASCII word runs longer than one character; a word of several camel-case or
    underscore parts also gives its parts. Null text gives null.
    """
    fine = lambda t: (F.length(t) > 1) & (~t.isin(STOP_WORDS) if stop_words else F.lit(True))

    def of_word(w: Column) -> Column:
        apart = F.regexp_replace(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.filter(F.split(apart, "[ _$]+"), lambda p: p != "")
        smaller = F.filter(F.transform(parts, F.lower), lambda p: p != F.lower(w))
        return F.concat(F.array(F.lower(w)), F.when(F.size(parts) > 1, smaller).otherwise(F.array().cast("array<string>")))

    words = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_$]+)"), F.lit(1))
    return F.filter(F.flatten(F.transform(words, of_word)), fine)


def exploded_tokens(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, term): the tokens of a column as rows.

    As tokens(), but a text is cut between its words and becomes rows at once; only
    in texts that have a word of several parts are such words looked for and taken apart.
    """
    mixed = "[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[_$]"
    words = F.split(text, "[^A-Za-z0-9_$]+")

    def smaller(w: Column) -> Column:
        apart = F.regexp_replace(F.regexp_replace(w, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
        parts = F.filter(F.split(apart, "[ _$]+"), lambda p: p != "")
        return F.when(F.size(parts) > 1, F.filter(parts, lambda p: F.lower(p) != F.lower(w))).otherwise(F.array().cast("array<string>"))

    more = F.flatten(F.transform(F.filter(words, lambda w: w.rlike(mixed)), smaller))
    every = F.when(F.col(text).rlike(mixed), F.concat(words, more)).otherwise(words)
    terms = rows.select(*keep, F.explode(every).alias("w")).where(F.length("w") > 1)
    return terms.select(*keep, F.lower("w").alias("term")).where(~F.col("term").isin(STOP_WORDS))


def ngrams(text: Column, n: int = 3) -> Column:
    """Lower-case windows of n characters of the trimmed text between two spaces."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(text)), F.lit(" "))
    chars = F.filter(F.split(padded, ""), lambda c: c != "")

    def windows(cs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(cs) - n, F.lit(0))), lambda i: F.concat(*[F.get(cs, i + k) for k in range(n)]))

    # The array around chars has them split once, not for each window.
    return F.when(F.length(padded) <= n, F.array(padded)).otherwise(F.transform(F.array(chars), windows)[0])


def fuzzy_score(query: Column, target: Column) -> Column:
    """How well query is a subsequence of target; null where it is none.

    1 a character, 4 more right behind the last match, 3 more at a boundary,
    less a tenth for each character that target is longer, up to 20.
    """
    q, t = F.lower(query), F.lower(target)
    start = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("last"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        at = F.call_function("locate", c, t, s.last + 1)
        before = F.when(at > 1, F.substring(t, at - 1, F.lit(1))).otherwise(F.lit(" "))
        gain = F.lit(1.0) + F.when((at == s.last + 1) & (s.last > 0), 4.0).otherwise(0.0)
        gain = gain + F.when(before.isin(" ", "/", "-", "_"), 3.0).otherwise(0.0)
        hit = s.ok & (at > 0)
        return F.struct(F.when(hit, s.score + gain).otherwise(s.score).alias("score"), F.when(hit, at).otherwise(s.last).alias("last"), hit.alias("ok"))

    done = F.aggregate(F.filter(F.split(q, ""), lambda c: c != ""), start, step)
    return F.when(F.length(query) == 0, 0.0).when(done.ok, done.score - F.least(F.length(t) - F.length(q), F.lit(20)) * 0.1)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 where it is above most."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty text."""
    n = F.length(text).cast("double")
    kinds = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    each = F.transform(kinds, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the characters' codes, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)) % F.lit(4294967296))


def truncate(text: Column, most: int) -> Column:
    """text, or its beginning and an ellipsis when longer than most."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…")))


def first_sentence(text: Column, most: int = 220) -> Column:
    """The first sentence, without marks of formatting."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, "[#*_>`]", ""), "\\s+", " "))
    found = F.regexp_extract(flat, "^(.+?[.!?])(?:\\s|$)", 1)
    return truncate(F.when(found == "", flat).otherwise(found), most)


def slug(text: Column, otherwise: str = "untitled") -> Column:
    """Lower-case ASCII words joined by hyphens."""
    plain = F.translate(F.lower(text), "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    out = F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", otherwise).otherwise(out)


def title_case(text: Column) -> Column:
    """Words with their first letter raised, the rest as it was."""
    apart = F.regexp_replace(F.regexp_replace(text, "[-_]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(apart, "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def format_bytes(n: Column) -> Column:
    """B, KB, MB, GB or TB with one decimal below 100."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / F.lit(float(1024**power))
        shown = F.when(v >= 100, F.format_string("%.0f", v)).otherwise(F.format_string("%.1f", v))
        out = F.when(n >= 1024**power, F.concat(shown, F.lit(f" {unit}"))).otherwise(out)
    return out


def token_estimate(text: Column) -> Column:
    """Tokens of a text by its length, punctuation and words; 1 at least."""
    guess = F.length(text) / 3.6 + 0.15 * F.regexp_count(text, F.lit("[^A-Za-z0-9_\\s]")) + 0.05 * F.regexp_count(text, F.lit("\\S+"))
    return F.greatest(F.ceil(guess), F.lit(1))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up, also below zero."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f
