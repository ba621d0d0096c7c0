"""Column functions over symbols, module paths and profile names. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators and the tokens that name no algorithm family.
FAMILY_SEPARATORS = "/-_.:(),;"
FAMILY_SKIP = ["ALG", "UTIL", "PRIM", "UNKNOWN", "FACTORY"]


def module_path(path: Column) -> Column:
    """a/b/c -> a.b.c"""
    return F.replace(path, F.lit("/"), F.lit("."))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def last_two_segments(name: Column) -> Column:
    return F.substring_index(name, ".", -2)


def suffix_equal(a: Column, b: Column) -> Column:
    """Equal, or one is a dotted suffix of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def function_tail(name: Column) -> Column:
    """Last part after `::`, then after `.`, without a ` [label]`."""
    return F.substring_index(F.substring_index(F.regexp_replace(name, r" \[[^\]]*\]$", ""), "::", -1), ".", -1)


def symbol_variants(name: Column) -> Column:
    """Full name, last two segments, last and first segment; each once."""
    return F.array_distinct(F.array(name, last_two_segments(name), last_segment(name), F.substring_index(name, ".", 1)))


def glob_pattern(glob: Column) -> Column:
    """Anchored regular expression of a glob in which only * is special."""
    return F.concat(F.lit("^"), F.replace(F.regexp_replace(glob, r"([.\\+?^$\[\]{}()|])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))


def family(text: Column) -> Column:
    """First alphabetic token of a profile that isn't a structural word, in upper case."""
    tokens = F.split(F.translate(F.upper(text), FAMILY_SEPARATORS, " " * len(FAMILY_SEPARATORS)), " +")
    return F.get(F.filter(tokens, lambda t: t.rlike("[A-Z]") & ~t.isin(FAMILY_SKIP)), 0)


def is_concrete(profile: Column) -> Column:
    """An ALG.* profile other than a random generator; null is not concrete."""
    p = F.upper(F.coalesce(profile, F.lit("")))
    return p.startswith("ALG.") & ~p.rlike("RNG")


def is_random(profile: Column) -> Column:
    return F.upper(F.coalesce(profile, F.lit(""))).rlike("RNG|RANDOM")


def ordered_distinct(items: Column) -> Column:
    return F.array_distinct(items)


def identifiers(code: Column, stop: tuple[str, ...] = ()) -> Column:
    """Identifiers in order of first sight, without `stop`."""
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def integers(text: Column) -> Column:
    """Whole numbers of 1 to 6 digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,6})\b"), 1), lambda x: x.cast("int"))


def top_level_split(args: Column) -> Column:
    """Split at commas outside brackets and quotes, with blanks trimmed. The scan is a fold over the characters."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(s: Column, c: Column) -> Column:
        quoted = s.quote != ""
        opens, closes = c.isin("(", "[", "{") & ~quoted, c.isin(")", "]", "}") & ~quoted
        cut = (c == ",") & (s.depth == 0) & ~quoted
        quote = F.when(quoted & (c == s.quote), F.lit("")).when(~quoted & c.isin('"', "'"), c).otherwise(s.quote)
        return F.struct(
            (s.depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            quote.alias("quote"),
            F.when(cut, F.concat(s.done, F.array(s.cur))).otherwise(s.done).alias("done"),
            F.when(cut, F.lit("")).otherwise(F.concat(s.cur, c)).alias("cur"),
        )

    def finish(s: Column) -> Column:
        every = F.concat(s.done, F.array(s.cur))
        return F.transform(every, lambda x: F.trim(x))

    return F.when(F.trim(args) == "", F.array().cast("array<string>")).otherwise(F.aggregate(F.filter(F.split(args, ""), lambda c: c != ""), start, step, finish))
