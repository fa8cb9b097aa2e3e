"""Keyword-stuffed pages, link lists and product tags.

Each page has a rank-frequency curve: the logarithm of a word's frequency
against the logarithm of its rank. Prose of one language and length follows
nearly one curve; pages made of repeated phrases leave it: they fall more
steeply, or hold far fewer words for their length. Curves are fitted with SQL
windows, and each page is set against prose (and where it is rich in signs
against code) of its language at comparable lengths.

Where the curve alone cannot tell - short pages, stuffed sentences, tags among
signs - the page's divergence from prose does, measured in nats a word:

links  a link with its anchor is one word. The divergence of the split of a
       page's words into links and others from that split in prose.
words  the log of a word's frequency on the extreme pages over that elsewhere,
       averaged over the page. Function words speak for prose; content words
       that the extreme pages hardly use tell a page's subject and count 0.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import LETTER, character_classes
from tidemark.llm.encoding import _slices
from tidemark.session import cut, written


@dataclass(frozen=True)
class Tongue:
    """A natural language: its commonest function words and the share of running prose that they make up."""

    share: float
    words: frozenset[str]


def _tongue(share: float, words: str) -> Tongue:
    return Tongue(share, frozenset(words.split()))


#: Function words of languages; of those without blanks between words, single characters.
TONGUES = {
    "en": _tongue(
        0.5,
        "a an the this that these those it its he she they we you i our your their his her is are was were be been being am has have had do does did"
        " will would can could may might must shall should not no nor so than too very of to in on at by for from with without into onto over under"
        " again then once before after until while since because as if unless but and or when where which who whom what how why there here all any"
        " both each few more most other some such only own same up down out off about between through during above below against per via one",
    ),
    "de": _tongue(0.36, "der die das den dem des ein eine einer und oder ist sind war wird nicht auch auf aus bei mit nach von zu zum zur im in für sich es er sie wir dass als wie"),
    "fr": _tongue(0.4, "le la les un une des du de et ou est sont était ne pas que qui dans sur pour par avec ce cette il elle nous vous se au aux en plus comme"),
    "es": _tongue(0.4, "el la los las un una de del y o es son era no que en por para con se su al lo como más pero este esta"),
    "ru": _tongue(0.24, "и в не на что с по как это из за к от но а о для так же то у или если он она мы они был быть"),
    "zh": _tongue(0.16, "的 一 是 不 了 在 有 我 他 这 中 来 和 们 也 就 要 会 可 为 以"),
    "ja": _tongue(0.36, "の に は を た が で て と し れ さ い も な る す ら か"),
}
FUNCTION_WORDS = TONGUES["en"].words
#: Signs of code, markup and data.
CODE_SIGNS = "{}()[];=<>/\\*&|^%$#@~`+_:0123456789"
#: Ranges of scripts written without blanks, where each character is taken for a word: Thai to Lao, Burmese, Khmer, kana, Han.
SOLO = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
#: The word that stands for a link.
LINK = " link"

#: A page needs this many words, and distinct words, for its curve to tell; two characters taken for words make one.
LEAST_WORDS, LEAST_DISTINCT = 30, 6
#: Pages with this share of function words (in English; other languages by their own shares) are prose; with that many code signs a word they are code or data.
PROSE, CODE = 0.25, 0.35
#: Departures from prose at comparable length: of log(words / distinct words), of the slope, of the residual.
CROWDED, STEEP, BENT = 0.55, -0.25, 0.10
#: A flatter slope than that of prose tells where words come at least so often each: one phrase again and again.
FLAT, OFTEN = 0.40, 5.0
#: Pages of a language and length that make a reference of their own, at least.
REFERENCE = 20
#: What prose is taken to be like where a corpus has fewer pages of it, and the bounds of its share of links.
NO_PROSE_AT_ALL = {"slope": -0.65, "residual": 0.2, "crowd": 0.6}
FEWEST_LINKS, MOST_LINKS = 0.005, 0.1
#: A word has a weight of its own if it is on so many extreme pages; weights are at most the log of LIFT, either way.
SUPPORT, LIFT = 3, 20.0
#: A table of up to so many words or pages is broadcast; beyond, the same join is shuffled.
BROADCAST_WORDS = 100_000
#: A word of at least so many letters may be made up of others, each of at least two letters.
LEAST_JOINT = 8
#: A prose-like or sign-rich page whose curve leaves its kind needs this share of words typical of the extreme pages.
BORNE_OUT = 0.06
#: Divergence of a page, in nats a word: of its links, of its words; and in nats over the whole page, at least.
LINKY, SPAMMY, EVIDENCE = 1.0, 0.25, 12.0

#: Ends of host names by which a link without a scheme is known.
HOST_ENDS = "com org net edu gov info biz io dev app co uk de fr nl eu ru jp cn us shop store online site xyz top club example test invalid"

_ENDS = r"\.(?:" + "|".join(HOST_ENDS.split()) + r")\b(?![\w(=-])(?:/[^\s)\]\"'<>|,;]*)?"
_SCHEME = re.compile(r"(?:https?://|www\.)[^\s)\]\"'<>]+", re.I)
_END = re.compile(_ENDS, re.I)
_HOST = re.compile(r"(?<![\w.@/-])[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\Z", re.I)


@functools.cache
def _code_signs() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in CODE_SIGNS]] = True
    return table


@functools.cache
def _solo() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for a, b in SOLO:
        table[a : b + 1] = True
    return table


def find_links(text: str) -> np.ndarray:
    """Begin and end of each link: with a scheme, or a host name known by its end, not part of a call or an address."""
    spans = [m.span() for m in _SCHEME.finditer(text)]
    begins, ends = np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)
    found = [m.span() for m in _END.finditer(text)]
    if found:
        place = np.searchsorted(begins, [a for a, _ in found], "right") - 1
        inside = (place >= 0) & (ends[place] > [a for a, _ in found]) if len(ends) else np.zeros(len(found), bool)
        last = 0
        for (a, b), skip in zip(found, inside.tolist()):
            # a host name has at most 253 signs
            host = None if skip or a < last else _HOST.search(text, max(last, a - 253), a)
            if host:
                spans.append((host.start(), b))
                last = b
    return np.array(sorted(spans), np.int64).reshape(-1, 2)


def anchored(text: str, spans: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The links with what they are tied to: [anchor](link), <a href=link>anchor</a>, [url=link]anchor[/url].

    starts: where each page of the text begins; no anchor leaves its page.
    Links within another one's anchor belong to that.
    """
    bounds = [*starts.tolist(), len(text) + 1]
    out: list[tuple[int, int]] = []
    closing = {"</a>": (-1, -1), "[/url]": (-1, -1)}  # page and place of the next one
    for a, b in spans.tolist():
        last = out[-1][1] if out else 0
        if a < last:
            continue
        page = bisect.bisect_right(bounds, a) - 1
        floor = max(last, bounds[page])
        if text[max(a - 2, 0) : a] == "](":
            at = text.rfind("[", max(floor, text.rfind("\n", floor, a) + 1), a - 2)
            out.append((at, b) if at >= 0 else (a, b))
            continue
        tag, bracket = text.rfind("<", floor, a), text.rfind("[", floor, a)
        at, end = (tag, "</a>") if tag > bracket else (bracket, "[/url]")
        opened = at >= 0 and text[at : at + 3].lower() in ("<a ", "<a\n", "<a\t") if end == "</a>" else at >= 0 and text[at : at + 4].lower() == "[url"
        if opened:
            known = closing[end]
            if known[0] != page or -1 < known[1] < b:
                rest = text.find(end, b, bounds[page + 1] - 1)
                closing[end] = known = (page, rest if rest >= 0 else text.find(end.upper(), b, bounds[page + 1] - 1))
            if known[1] >= 0:
                out.append((at, known[1] + len(end)))
                continue
        out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


class Pages:
    """Word counts and other measures of a batch of texts."""

    def __init__(self, texts: pa.Array):
        listed = [t or "" for t in texts.to_pylist()]
        n = len(listed)
        joined = "\n".join(listed)
        self.chars = np.array([len(t) for t in listed], np.int64)
        starts = np.concatenate([[0], np.cumsum(self.chars + 1)])[:n]
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        spans = anchored(joined, find_links(joined), starts)
        page_of_link = np.searchsorted(starts, spans[:, 0], "right") - 1
        self.links = np.bincount(page_of_link, minlength=n)
        edge = np.zeros(len(points) + 1, np.int8)
        edge[spans[:, 0]] += 1
        np.add.at(edge, spans[:, 1], -1)
        outside = np.cumsum(edge[:-1], dtype=np.int8) == 0
        bounds = np.append(starts, len(points)).astype(np.int64)
        signs = np.concatenate([[0], np.cumsum(_code_signs()[points] & outside)])
        self.code = signs[bounds[1:]] - signs[bounds[:-1]]
        letter = (character_classes()[points] == LETTER) & outside
        alone = letter & _solo()[points]
        # a word begins with a letter after none, and with each letter that is a word of its own or follows one
        before = np.concatenate([[False], letter[:-1] & ~alone[:-1]])
        after = np.concatenate([letter[1:] & ~alone[1:], [False]]) if len(letter) else letter
        begin, end = np.flatnonzero(letter & (alone | ~before)), np.flatnonzero(letter & (alone | ~after)) + 1
        # names of tags are no words
        previous = np.where(begin > 0, points[begin - 1] if len(points) else 0, 0)
        ahead = np.where(begin > 1, points[begin - 2] if len(points) else 0, 0)
        kept = ~((previous == ord("<")) | ((previous == ord("/")) & (ahead == ord("<"))))
        inside = np.repeat(kept, end - begin)
        packed = points[letter][inside].tobytes()
        begin, end = begin[kept], end[kept]
        page = np.searchsorted(starts, begin, "right") - 1
        # slices of letters only: what stands between two words has been cut out
        offsets = np.concatenate([[0], np.cumsum((end - begin) * 4)]).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        lower = pa.array([w.decode("utf-32-le").lower() for w in found.dictionary.to_pylist()], pa.string()).dictionary_encode()
        self.vocabulary: list[str] = [*lower.dictionary.to_pylist(), LINK]
        word = lower.indices.to_numpy()[found.indices.to_numpy()].astype(np.int64) if len(begin) else np.zeros(0, np.int64)
        own = [np.array([w in t.words for w in self.vocabulary], bool) for t in TONGUES.values()]
        table = np.stack([np.bincount(page, x[word], n) for x in own])
        best = table.argmax(axis=0)
        # in units of English, so that one share tells prose in every language
        scale = np.array([TONGUES["en"].share / t.share for t in TONGUES.values()])
        self.function = np.floor(table.max(axis=0) * scale[best]).astype(np.int64)
        self.tongue = np.array(list(TONGUES), object)[best]
        self.page = np.concatenate([page, page_of_link])
        self.word = np.concatenate([word, np.full(len(page_of_link), len(self.vocabulary) - 1)])
        self.words = np.bincount(self.page, minlength=n)
        single = np.searchsorted(starts, np.flatnonzero(alone), "right") - 1
        self.single = np.bincount(single, minlength=n)

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, word, count) of each distinct word of each page, in order of pages."""
        size = len(self.vocabulary)
        key, count = np.unique(self.page.astype(np.int64) * size + self.word, return_counts=True)
        return key // size, key % size, count


PROFILE = "lang string, tongue string, words bigint, distinct bigint, function bigint, code bigint, links bigint, single bigint, counts array<int>, terms array<string>"


def profiles(documents: DataFrame, doc: str, text: str, lang: str) -> DataFrame:
    """A row of measures for each page: one pass over the texts, no shuffle."""
    schema = T.StructType([T.StructField("doc", documents.schema[doc].dataType), *T._parse_datatype_string(PROFILE).fields])
    source = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in _slices(texts):
                p = Pages(texts.slice(a, b - a))
                n = b - a
                page, word, count = p.counts()
                distinct = np.bincount(page, minlength=n)
                lists = np.concatenate([[0], np.cumsum(distinct)]).astype(np.int32)
                columns = [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(p.tongue, pa.string())]
                columns += [pa.array(x.astype(np.int64)) for x in (p.words, distinct, p.function, p.code, p.links, p.single)]
                columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(count.astype(np.int32))))
                columns.append(pa.ListArray.from_arrays(pa.array(lists), pa.array(p.vocabulary, pa.string()).take(pa.array(word))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def _prose():
    return F.col("function") >= PROSE * F.col("words")


def _code():
    return F.col("code") >= CODE * F.col("words")


def curves(pages: DataFrame) -> DataFrame:
    """slope and residual of each page's rank-frequency curve, least squares weighted by 1 / rank.

    The counts come together by page once, as one list each; window and sums
    need no further exchange.
    """
    fitted = pages.where((F.col("words") - F.col("single") / 2 >= LEAST_WORDS) & (F.col("distinct") >= LEAST_DISTINCT))
    ranked = fitted.select("page", "counts").repartition("page").select("page", F.explode("counts").alias("__n"))
    place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("__n")))
    points = ranked.select("page", F.log(place).alias("__x"), F.log("__n").alias("__y")).withColumn("__w", F.exp(-F.col("__x")))
    sums = points.groupBy("page").agg(
        F.sum("__w").alias("w"),
        *(F.sum(F.col("__w") * v).alias(k) for k, v in (("wx", F.col("__x")), ("wy", F.col("__y")), ("wxx", F.col("__x") * F.col("__x")), ("wxy", F.col("__x") * F.col("__y")), ("wyy", F.col("__y") * F.col("__y")))),
    )
    mx, my = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
    sxx, sxy, syy = F.col("wxx") / F.col("w") - mx * mx, F.col("wxy") / F.col("w") - mx * my, F.col("wyy") / F.col("w") - my * my
    fit = sums.select("page", (sxy / sxx).alias("slope"), F.sqrt(F.greatest(F.lit(0.0), syy - sxy * sxy / sxx)).alias("residual"))
    return fit.join(fitted.select("page", "lang", "tongue", "words", "distinct", "function", "code"), "page").withColumn("crowd", F.log(F.col("words") / F.col("distinct")))


def _line(every, measure: str):
    a, b = every[f"{measure}_a"], every[f"{measure}_b"]
    if every["n"] < REFERENCE or a is None or b is None:
        return F.lit(NO_PROSE_AT_ALL[measure])
    return F.lit(a) + F.lit(b) * F.greatest(F.lit(every["low"]), F.least(F.lit(every["high"]), F.log("words")))  # not beyond the lengths seen


def departures(fitted: DataFrame) -> DataFrame:
    """Whether each page's curve leaves that of prose, and with many code signs also that of code.

    A curve is held against the median of its kind's pages of comparable
    length (words to a power of two): of its language and file type, of its
    file type, of any - the first of which there are enough; where there are
    not, against the line over the logarithm of length through all of them.
    """
    banded = fitted.withColumn("band", F.floor(F.log2("words")))
    measures = ("slope", "residual", "crowd")
    kinds = {"prose": banded.where(_prose()), "code": banded.where(~_prose() & _code())}
    references = {"prose": (["tongue", "lang", "band"], ["lang", "band"], ["band"]), "code": (["lang", "band"], ["band"])}
    joined, leaves = banded, F.lit(True)
    for kind, pages in kinds.items():
        names = []
        for keys in references[kind]:
            prefix = f"{kind}_{len(keys)}"
            own = pages.groupBy(*keys).agg(*(F.percentile_approx(m, 0.5, 1000).alias(f"{prefix}_{m}") for m in measures), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= REFERENCE).drop("__n")
            joined = joined.join(own, keys, "left")
            names.append(prefix)
        every = pages.agg(F.count(F.lit(1)).alias("n"), F.min(F.log("words")).alias("low"), F.max(F.log("words")).alias("high"), *(f(F.col(m), F.log("words")).alias(f"{m}_{k}") for m in measures for k, f in (("b", F.regr_slope), ("a", F.regr_intercept)))).first()
        slope, residual, crowd = (F.col(m) - F.coalesce(*(f"{p}_{m}" for p in names), _line(every, m)) for m in measures)
        away = (crowd >= CROWDED) | ((slope <= STEEP) & (residual >= BENT)) | ((slope >= FLAT) & (F.col("words") >= OFTEN * F.col("distinct")))
        leaves = leaves & (away if kind == "prose" else away | _prose() | ~_code())
    return joined.select("page", "words", "function", "code", leaves.alias("leaves"))


def extreme(departed: DataFrame) -> DataFrame:
    """Pages whose curve leaves that of their kind; `alone`: neither prose nor code, so that nothing but the curve need tell.

    Code and data leave the curve of code as far as spam does, being
    repetitive themselves, and so do licences and tables that of prose: there
    the words must bear the curve out.
    """
    return departed.where("leaves").select("page", (~_prose() & ~_code()).alias("alone"))


def linked(pages: DataFrame) -> DataFrame:
    """Pages whose split of words into links and others diverges from that of prose of their language and length."""
    banded = pages.select("page", "tongue", "words", "links", "function", F.floor(F.log2(F.greatest("words", F.lit(1)))).alias("band"))
    prose = banded.where(_prose() & (F.col("words") > 0))
    share = F.sum("links") / F.sum("words")
    own = prose.groupBy("tongue", "band").agg(share.alias("__own"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= REFERENCE).drop("__n")
    every = prose.agg(share.alias("q")).first()["q"]
    p = F.col("links") / F.col("words")
    q = F.greatest(F.lit(FEWEST_LINKS), F.least(F.lit(MOST_LINKS), F.coalesce("__own", F.lit(0.0 if every is None else every))))
    rest = F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)
    nats = F.when(p > q, p * F.log(p / q) + rest).otherwise(0.0)
    held = banded.where(F.col("links") > 0).join(own, ["tongue", "band"], "left").withColumn("__nats", nats)
    return held.where((F.col("__nats") >= LINKY) & (F.col("__nats") * F.col("words") >= EVIDENCE)).select("page")


def _terms(pages: DataFrame) -> DataFrame:
    """(page, word, n) of each distinct word of the pages; a link is none."""
    return pages.select("page", F.inline(F.arrays_zip(F.col("terms").alias("word"), F.col("counts").alias("n")))).toDF("page", "word", "n").where(F.col("word") != LINK)


def _hinted(words: DataFrame, number: int) -> DataFrame:
    return F.broadcast(words) if number <= BROADCAST_WORDS else words


def weights(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(word, rate, elsewhere, outside) of all words on SUPPORT of the extreme pages.

    rate: the log of the word's frequency there. elsewhere: how often it
    occurs on other pages, which have `outside` words in all. However many
    topics the extreme pages have, no word is left out for its share of them,
    and none is collected. Function words are left out.
    """
    found = cut(found.select("page"))
    lent = pages.select("page", "words", "links", "terms", "counts").join(_hinted(found, found.count()), "page", "left_semi")
    there = _terms(lent).groupBy("word").agg(F.sum("n").alias("there"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= SUPPORT).drop("pages")
    there = there.where(~F.col("word").isin(sorted({w for t in TONGUES.values() for w in t.words})))
    there = cut(there)
    sizes = pages.agg(F.sum(F.col("words") - F.col("links"))).first()[0] or 0
    inside = lent.agg(F.sum(F.col("words") - F.col("links"))).first()[0] or 0
    totals = _terms(pages).join(_hinted(there.select("word"), there.count()), "word", "left_semi").groupBy("word").agg(F.sum("n").alias("total"))
    return there.join(totals, "word").select("word", F.log(F.col("there") / F.lit(float(max(inside, 1)))).alias("rate"), (F.col("total") - F.col("there")).alias("elsewhere"), F.lit(float(max(sizes - inside, 0) + 1)).alias("outside"))


def _weight(own: Column):
    """The log of a word's frequency on the extreme pages over that elsewhere, a page's own uses left out: within log(LIFT) either way, whatever the size of the corpus."""
    ratio = F.col("rate") - F.log((F.greatest(F.col("elsewhere") - own, F.lit(0)) + 1) / F.col("outside"))
    bound = math.log(LIFT)
    return F.least(F.lit(bound), F.greatest(F.lit(-bound), ratio))


def made_up(vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """Words of the vocabulary that are made up of `words` (of two letters or more), one after the other."""
    parts = words.where(F.length("word") > 1).select(F.col("word").alias("part"))
    number = parts.count()
    if not number:
        return parts.select(F.col("part").alias("word"))
    # only lengths that occur are cut out; n of them take up n (n + 1) / 2 letters of the lexicon at least
    lengths = F.lit(sorted(r[0] for r in parts.select(F.length("part")).distinct().collect()))
    parts, size = _hinted(parts, number), F.length("word")
    long = vocabulary.select("word").where(size >= LEAST_JOINT).distinct()

    def pieces(begin):
        return F.transform(F.filter(lengths, lambda n: n <= size - begin), lambda n: F.struct(begin.alias("begin"), (begin + n).alias("end"), F.substring("word", begin + 1, n).alias("part")))

    # few words begin with one of the parts: only these are taken apart
    heads = long.select("word", F.inline(pieces(F.lit(0)))).join(parts, "part", "left_semi").select("word").distinct()
    every = F.flatten(F.transform(F.sequence(F.lit(0), size - 2), pieces))
    spans = heads.select("word", F.inline(every)).join(parts, "part", "left_semi")
    listed = spans.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    reached = F.aggregate("spans", F.array(F.lit(0)), lambda to, s: F.when(F.array_contains(to, s["begin"]), F.array_union(to, F.array(s["end"]))).otherwise(to))
    return listed.where(F.array_contains(reached, size)).select("word")


def divergences(pages: DataFrame, weighed: DataFrame) -> DataFrame:
    """(page, words, typical, nats): how many of its words are typical of the extreme pages, and its divergence over all words.

    A word without a weight that is made up of typical ones (as tags are)
    weighs as much as they do. Pages without any weighed word are left out.
    """
    weighed = cut(weighed)
    most = F.lit(math.log(LIFT))
    typical = weighed.where(_weight(F.lit(0)) >= most).select("word")
    joint = made_up(_terms(pages).select("word"), typical).join(weighed.select("word"), "word", "left_anti")
    every = cut(weighed.unionByName(joint, allowMissingColumns=True))
    own = _terms(pages).join(_hinted(every, every.count()), "word").withColumn("__weight", F.when(F.col("rate").isNull(), most).otherwise(_weight(F.col("n"))))
    own = own.groupBy("page").agg(F.sum(F.col("n") * F.col("__weight")).alias("own"), F.sum(F.when(F.col("__weight") >= most, F.col("n")).otherwise(0)).alias("typical"))
    return pages.select("page", "words", "function").join(own, "page").select("page", "words", "typical", (F.col("own") - most * F.col("function")).alias("nats"))


def spam(documents: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc, reason) of each spam page: curve, links or words, as the module says; a page may have several.

    Null and empty texts are no spam; whole texts are read, whatever their
    length. Copies are judged alike. A null language is a language of its own.
    The texts are read once; the measures of the pages are written as a table
    to the checkpoint folder, and everything else follows from that.
    """
    pages = written(profiles(documents, doc, text, lang).withColumn("page", F.monotonically_increasing_id()), "pages")
    left = cut(extreme(departures(cut(curves(pages)))))
    listed = cut(linked(pages))
    alone = left.where("alone").select("page")
    told = cut(divergences(pages, weights(pages, alone.union(listed).distinct())))
    stuffed = told.where((F.col("nats") >= SPAMMY * F.col("words")) & (F.col("nats") >= EVIDENCE)).select("page")
    borne = told.where((F.col("typical") >= BORNE_OUT * F.col("words")) & (F.col("typical") >= SUPPORT)).join(left.where("not alone"), "page", "left_semi").select("page")
    reasons = {"curve": alone.union(borne), "links": listed, "words": stuffed}
    marked = functools.reduce(DataFrame.union, (d.select("page", F.lit(r).alias("reason")) for r, d in reasons.items()))
    return pages.select("page", "doc").join(marked, "page").select(F.col("doc").alias(doc), "reason")
