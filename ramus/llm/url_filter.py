"""URL filters: host/path rules first, else a weighted URL vocabulary.

The vocabulary is matched by one Aho-Corasick automaton over the lower-cased url; a hit counts
only between characters that are not ASCII letters or digits. A strict term weighs 1 and a soft
term 0.5, distinct terms once each, and a url whose weights reach 1 is blocked: one strict term,
or two distinct soft ones. A table may give other terms, graded as finely as one likes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Terms that mark a url alone, and terms of which two different ones do.
STRICT = tuple(
    "adult adultchat blackjack bordello bukkake camgirl camgirls camsex casino cialis creampie cumshot dildo escort escorts fetish gangbang gonzo hentai "
    "hookup jackpot keygen levitra malware milf naked nsfw nude nudes orgasm phishing porn porno pornhub pornstar roulette sex sexcam sexchat sexshop sexy "
    "shemale slut spam spyware stripper swinger threesome tramadol trojan viagra warez webcamsex xanax xrated xxx".split()
)
SOFT = tuple(
    "ad ads adserver affiliate affiliates amateur apuestas babe babes banner bet bets betting bingo bonus bonuses buy cam cams cash cheap clickbait click clicks clones "
    "coupon coupons crack cracked credit crypto dating deal deals debt diet discount doubleclick download earn erotic exploit farm forex free freebie gamble gambling "
    "giveaway girls guaranteed hack hacks hot income instant kostenlos lingerie loan loans lottery lotto lucky mature mirror miracle money odds offer offers payday "
    "pharma pharmacy pill pills poker popunder popup prize prizes profit promo promos proxy replica rich sale serial singles slot slots spins sponsor sportsbook "
    "sweepstakes teen torrent torrents track tracker tracking trial unlock wager webcam wetten win winner winners winning".split()
)
#: What a term weighs; a url is blocked from LIMIT on.
LIMIT = 1.0
VOCABULARY = dict.fromkeys(SOFT, 0.5) | dict.fromkeys(STRICT, 1.0)
#: Rows of a vocabulary table at most; it is held by every task.
VOCABULARY_ROWS = 1_000_000
#: (host, path) and verdict; the longest fitting rule wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ordered(rules=RULES) -> list[tuple[str, str, str, str]]:
    """(rule, verdict, host, path), longest first; equal lengths in text order."""
    split = [(r, v, r.partition("/")[0], "/" + r.partition("/")[2]) for r, v in rules]
    return sorted(split, key=lambda x: (-len(x[0]), x[0]))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v, h, p in reversed(ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def vocabulary_of(table: DataFrame) -> dict[str, float]:
    """A vocabulary from a table (term, weight) of at most VOCABULARY_ROWS rows; terms are lower-cased, of
    repeated ones the heaviest counts, empty and null ones are left out."""
    rows = table.select(F.lower(F.col("term").cast("string")).alias("t"), F.col("weight").cast("double").alias("w")).where("t <> '' and w is not null")
    rows = rows.groupBy("t").agg(F.max("w").alias("w")).limit(VOCABULARY_ROWS + 1).collect()
    if len(rows) > VOCABULARY_ROWS:
        raise ValueError(f"a vocabulary has at most {VOCABULARY_ROWS} terms")
    return {r.t: r.w for r in rows}


def automaton(vocabulary=VOCABULARY):
    a = ahocorasick.Automaton()
    for term, weight in vocabulary.items():
        a.add_word(term, (term, weight))
    if vocabulary:
        a.make_automaton()
    return a


def _word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def weight_of(a, url: str | None) -> float:
    """Sum of the weights of the distinct terms of a url."""
    found = {}
    if not len(a):
        return 0.0
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    for end, (term, weight) in a.iter(text):
        begin = end - len(term)
        if (begin < 0 or not _word(text[begin])) and (end + 1 == len(text) or not _word(text[end + 1])):
            found[term] = weight
    return sum(found.values())


def _weigh(vocabulary):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for b in frames:
            w = [weight_of(a, u) for u in b.column(b.schema.names.index("url")).to_pylist()]
            yield b.append_column("weight", pa.array(w, pa.float64()))

    return run


def filter_urls(pages: DataFrame, rules=RULES, vocabulary=VOCABULARY) -> DataFrame:
    """(page_id, host, path, rule, verdict, weight) of every row of pages (page_id, url).

    A null url, and one without ://, has an empty host and path and no rule; its verdict comes
    from the vocabulary (allow for null). Repeated rows and repeated ids are judged row by row,
    very long urls are read whole. Of rules of equal length the first in text order wins. Other columns are ignored; an empty table gives no rows.
    """
    weighed = pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(
        _weigh(vocabulary), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, weight double"
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    got = weighed.select("page_id", host.alias("host"), path.alias("path"), "weight")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("weight") >= LIMIT, "block").otherwise("allow")
    return got.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "weight")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("weight")


def op6_sql() -> str:
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    strict = " OR ".join(hit(t) for t in STRICT)
    soft = " + ".join(f"CAST({hit(t)} AS INT)" for t in SOFT)
    fits = [(r, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for r, v, h, p in ordered()]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for r, _, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for _, v, c in fits)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH a AS (
  SELECT page_id, {low.format("coalesce(url, '')")} AS u,
         coalesce({low.format("regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1)")}, '') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN ({strict}) OR ({soft}) >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM a"""
