"""One consistent form for texts that look the same but differ in their characters.

A token (a maximal run of anything but spaces) is plain if it holds no look-alike, ignorable or composed-apart
character. The plain tokens of the corpus, with their counts, are its vocabulary. Each other token runs through a trie
of vocabulary words with a weighted edit automaton: dropping an ignorable character, reading a look-alike as the letter
it looks like most and reading decomposed letters as the composed one cost nothing; its further readings (a stroke can
be I or l) cost ``FURTHER`` each; anything else costs 1, which is beyond ``BOUND``. The cheapest word, then the most
frequent one, is the token's canonical spelling; a token that no word accepts is normalised by the table alone.

All readings of a look-alike fall into one class of letters, and a token can only be accepted by words of the same
classes, its skeleton. So tokens and words are dealt by skeleton and come sorted by it; a trie takes the words of many
skeletons, up to ``WORDS``, and is then begun anew. No vocabulary is collected or sent to all tasks, each distinct token
is decided once, however many texts hold it, and a skeleton with very many tokens is dealt over several tasks.

What stays different: letter case, accents, digits, ornaments such as circles, any further visible character. Null
texts stay null and are in no pair; empty texts are one form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hanmaru.llm._common import stash

# Letters of other scripts with the shape of a Latin letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYX3aesijopcyxhdqwv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυκ", "ABEZHIKMNOPTYXovipuk"))
OTHER = dict(zip("ԌԍՏօսոհաӀΙⅼⅰⅴⅹⅽⅾⅿꓐꓑꓒꓓ", "GgSounhaIIlivxcdmBPDD"))
SHAPES = {k: v for k, v in (CYRILLIC | GREEK | OTHER).items() if not v.isdigit()}
# Hyphens that look the same; dashes of other lengths and the minus sign are further characters.
HYPHENS = "\u2010\u2011\ufe63\uff0d"
# Characters without a shape.
IGNORABLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b"
    "\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062"
    "\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f"
    "\u3164\ufeff\uffa0\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08"
    "\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"
)
# Further letters that one of another script can stand for.
SECOND = {"\u0406": "l", "\u04c0": "l", "\u0399": "l", "\u03c5": "v", "\u0578": "u"}
FURTHER, BOUND = 0.25, 0.75
#: Kinds of space other than U+0020 (category Zs).
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


@lru_cache(maxsize=65536)
def shape(char: str) -> str:
    """What one character looks like: '' for ignorable ones, else the plain spelling of its shape."""
    if char in IGNORABLE:
        return ""
    if char in SPACES:
        return " "
    if char in HYPHENS:
        return "-"
    if char in SHAPES:
        return SHAPES[char]
    kind = unicodedata.decomposition(char).split(" ", 1)[0]
    if kind in ("<wide>", "<narrow>"):
        return shape(unicodedata.normalize("NFKC", char))
    return char


@lru_cache(maxsize=65536)
def table_form(token: str) -> str:
    """Canonical form by table: ignorables dropped, shapes replaced, letters and accents composed."""
    if token.isascii():
        return token
    out = unicodedata.normalize("NFC", "".join(map(shape, token)))
    # A composed letter of another script (a Cyrillic letter with an accent) hides its base.
    apart = unicodedata.normalize("NFD", out)
    return unicodedata.normalize("NFC", "".join(SHAPES.get(c, c) for c in apart))


def plain(token: str) -> bool:
    return token.isascii() or table_form(token) == token


@lru_cache(maxsize=65536)
def readings(char: str) -> tuple[tuple[str, float], ...]:
    """What a character of a decomposed token may stand for, decomposed, and at what cost."""
    first = unicodedata.normalize("NFD", shape(char))
    return ((first, 0.0), (SECOND[char], FURTHER)) if char in SECOND else ((first, 0.0),)


def letter_classes() -> dict[str, str]:
    """Each letter that is a reading of an ambiguous look-alike -> the letter that stands for its class."""
    classes: dict[str, set[str]] = {}
    for char, further in SECOND.items():
        joined = {shape(char), further}
        for letter in tuple(joined):
            joined |= classes.get(letter, set())
        classes.update(dict.fromkeys(joined, joined))
    return {letter: min(group) for letter, group in classes.items() if letter != min(group)}


CLASSES = letter_classes()
CLASS_TABLE = str.maketrans(CLASSES)


def skeleton(token: str) -> str:
    """The classes of a token's letters: the same for all its readings."""
    apart = "".join(readings(c)[0][0] for c in unicodedata.normalize("NFD", token))
    return unicodedata.normalize("NFC", apart.translate(CLASS_TABLE))


class Trie:
    """Words in canonical decomposition, so that composed and decomposed spellings share their path."""

    __slots__ = ("next", "word")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.word: tuple[int, str] | None = None

    def add(self, word: str, n: int) -> None:
        node = self
        for char in unicodedata.normalize("NFD", word):
            node = node.next.setdefault(char, Trie())
        if node.word is None or (node.word[0], word) < (n, node.word[1]):
            node.word = (n, word)

    def accept(self, token: str, bound: float = BOUND, other: float = 1.0) -> tuple[float, str] | None:
        """(cost, word) of the cheapest word within bound, of several the most frequent: the weighted edit automaton.

        Its states are (node, cost) pairs; each character of the token moves all of them along each of its readings, or,
        at the cost of other, to any letter or past the character.
        """
        states: dict[int, tuple[float, Trie]] = {id(self): (0.0, self)}
        for char in unicodedata.normalize("NFD", token):
            moved: dict[int, tuple[float, Trie]] = {}

            def reach(node: Trie, cost: float) -> None:
                if cost <= bound and (id(node) not in moved or moved[id(node)][0] > cost):
                    moved[id(node)] = (cost, node)

            for cost, node in states.values():
                for letters, price in readings(char):
                    at: Trie | None = node
                    for c in letters:
                        at = at.next.get(c) if at else None
                    if at:
                        reach(at, cost + price)
                if char in node.next:
                    reach(node.next[char], cost)
                if cost + other <= bound:
                    reach(node, cost + other)
                    for way in node.next.values():
                        reach(way, cost + other)
            states = moved
            if not states:
                return None
        ends = [(cost, -node.word[0], node.word[1]) for cost, node in states.values() if node.word]
        return (lambda e: (e[0], e[2]))(min(ends)) if ends else None


def by_table(token: Column) -> Column:
    @F.pandas_udf("string")
    def run(column):  # type: ignore[no-untyped-def]
        return column.map(table_form, na_action="ignore")

    return run(token)


def tokens(text: Column) -> Column:
    """Split at each space of any kind; the spaces become U+0020."""
    return F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1)


def odd(text: Column) -> Column:
    """Whether a text may hold a look-alike, ignorable or decomposed character."""
    return text.rlike(r"[^\x00-\x7F가-힣]")


#: Words of a trie, tokens that go through it at a time, distinct tokens of a skeleton that one task takes.
WORDS, AT_ONCE, DEALT = 20_000, 20_000, 50_000


def spellings(rows: DataFrame) -> DataFrame:
    """(token, canonical, word): a row for each distinct token that isn't plain already; word says whether a word was found."""
    words = rows.select(F.explode(tokens(F.col("text"))).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            columns = [batch.column(0), batch.column(1), pa.array(map(skeleton, values), pa.string()), pa.array(map(plain, values), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "n", "skeleton", "plain"])

    strange = words.where(odd(F.col("token"))).mapInArrow(described, "token string, n long, skeleton string, plain boolean")
    usual = words.where(~odd(F.col("token"))).select("token", "n", F.translate("token", "".join(CLASSES), "".join(CLASSES.values())).alias("skeleton"), F.lit(True).alias("plain"))
    known = stash(strange.unionAll(usual))
    # Only skeletons of tokens to decide need words; a skeleton of very many tokens is dealt over several tasks.
    asked = known.where("not plain").groupBy("skeleton").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    rows_ = known.join(asked, "skeleton")
    copies = F.when(F.col("plain"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("token"), F.col("parts")).cast("int")))
    dealt = rows_.select("token", "n", "skeleton", "plain", F.explode(copies).alias("part")).repartition("skeleton", "part").sortWithinPartitions("skeleton", "part", F.desc("plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, size, now, waiting = Trie(), 0, None, []

        def decided() -> pa.RecordBatch:
            got = [trie.accept(t) for t in waiting]
            spelt = [g[1] if g else table_form(t) for g, t in zip(got, waiting)]
            columns = [pa.array(waiting, pa.string()), pa.array(spelt, pa.string()), pa.array([g is not None for g in got], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["token", "canonical", "word"])

        for batch in batches:
            for token, n, key, plain_ in zip(*(batch.column(k).to_pylist() for k in ("token", "n", "skeleton", "plain"))):
                if len(waiting) >= AT_ONCE or (key != now and size >= WORDS):
                    yield decided()
                    waiting = []
                if key != now and size >= WORDS:
                    trie, size = Trie(), 0
                now = key
                if plain_:  # the words of a skeleton come before its tokens
                    trie.add(token, n)
                    size += 1
                else:
                    waiting.append(token)
        if waiting:
            yield decided()

    return dealt.select("token", "n", "skeleton", "plain").mapInArrow(run, "token string, canonical string, word boolean")


def identity(text: Column, name: str) -> list[Column]:
    """Two independent hashes that stand for a text in shuffles."""
    return [F.xxhash64(text).alias(f"{name}1"), F.xxhash64(F.lit(name), text).alias(f"{name}2")]


def canonical(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """(columns to keep, key, text, canonical): every row of df once, repeated rows included; null stays null."""
    rows = df.select(*(F.col(c).alias(f"_{c}") for c in keep), F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    texts = rows.where(F.col("text").isNotNull()).select("text")
    strange = F.coalesce(odd(F.col("text")), F.lit(False))
    parts = texts.where(odd(F.col("text"))).distinct().select(*identity(F.col("text"), "t"), F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    rewritten = (
        parts.join(spellings(texts), "token", "left").groupBy("t1", "t2")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical", "token").alias("t")))), lambda x: x["t"]), " ").alias("canonical"))
    )
    names = [*(F.col(f"_{c}").alias(c) for c in keep), "key", "text"]
    done = rows.where(strange).select("*", *identity(F.col("text"), "t")).join(rewritten, ["t1", "t2"]).select(*names, "canonical")
    return done.unionAll(rows.where(~strange).select(*names, F.col("text").alias("canonical")))


#: Rows of one text that are paired at a time: a text under more keys is dealt over several tasks.
BLOCK = 500


def alike(df: DataFrame, key: str, text: str, *within: str) -> DataFrame:
    """(columns within, key_a, key_b), key_a < key_b: texts that differ and read the same, in rows with the same columns within.

    Rows are paired by their canonical form; copies of a row under one key give no pair. Every key of a text is paired,
    so the pairs of two variants grow with the product of their rows. Columns within hold no null.
    """
    rows = canonical(df, key, text, *within).where(F.col("text").isNotNull() & F.col("key").isNotNull())
    forms = stash(rows.select(*within, "key", *identity(F.col("canonical"), "c"), *identity(F.col("text"), "t")).distinct())
    # Variants of a form meet as texts, so that copies under many keys aren't compared with each other.
    variants = forms.groupBy(*within, "c1", "c2", "t1", "t2").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    side = lambda x: variants.select(*within, "c1", "c2", *(F.col(c).alias(f"{c}{x}") for c in ("t1", "t2", "parts")))
    pairs = side("a").join(side("b"), [*within, "c1", "c2"]).where("t1a <> t1b or t2a <> t2b")
    for x in "ab":
        pairs = pairs.withColumn(f"part{x}", F.explode(F.sequence(F.lit(0), F.col(f"parts{x}") - 1)))
    dealt = forms.join(variants, [*within, "c1", "c2", "t1", "t2"]).withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    keyed = lambda x: dealt.select(*within, F.col("key").alias(f"key_{x}"), *(F.col(c).alias(f"{c}{x}") for c in ("t1", "t2", "part")))
    for x in "ab":
        pairs = pairs.join(keyed(x), [*within, f"t1{x}", f"t2{x}", f"part{x}"])
    return pairs.where("key_a < key_b").select(*within, "key_a", "key_b").distinct()
