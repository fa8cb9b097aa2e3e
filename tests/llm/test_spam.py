import random

import pyarrow as pa
import pytest

from tidemark.llm import spam

NOUNS = ["desk lamp", "roof box", "yoga mat", "car loan", "tile saw", "wall clock"]
LURES = "cheap buy best sale discount official wholesale coupon review online".split()
THINGS = "buffer window table index segment node cursor record stream vector filter matrix block packet signal channel".split()


def phrases(r, n):
    noun = r.choice(NOUNS)
    return [" ".join([r.choice(LURES), noun if r.random() < 0.8 else r.choice(NOUNS), *([r.choice(LURES)] if r.random() < 0.4 else [])]) for _ in range(n)]


def sentence(r):
    a, b, c = r.sample(THINGS, 3)
    return r.choice(
        [
            f"The {a} is kept until the {b} has been read, so that no {c} is lost while it waits for the next one.",
            f"If a {a} does not fit into the {b}, we write it to the {c} and try again after {r.randint(2, 99)} seconds.",
            f"Call this before the first {a}: it opens the {b} and checks that every {c} belongs to it.",
            f"There may be more than one {a} for each {b}; their {c} decides which of them is used.",
        ]
    )


def prose(r, n):
    return "# Notes\n\n" + " ".join(sentence(r) for _ in range(n))


def code(r, n):
    return "\n".join(f"def {r.choice(THINGS)}_{i}(x, y={r.randint(0, 99)}):\n    return self.{r.choice(THINGS)}[x] + {r.choice(THINGS)}(y)" for i in range(n))


def links(r, n, explained):
    out = [f"- [{r.choice(THINGS)}](https://{r.choice(THINGS)}.example/{r.choice(THINGS)}/{i})" + (f": {sentence(r)}" if explained else "") for i in range(n)]
    return "\n".join(out)


def lock(r, n):
    return "\n".join(f'"{r.choice(THINGS)}@^{i}.2":\n  version "{i}.2.{i}"\n  resolved "https://packages.example/{r.choice(THINGS)}.tgz#{r.getrandbits(64):x}"\n' for i in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    sound = [prose(r, r.randint(3, 25)) for _ in range(150)] + [code(r, r.randint(3, 40)) for _ in range(60)] + [links(r, 12, True) for _ in range(15)] + [lock(r, 12) for _ in range(15)]
    bad = [", ".join(phrases(r, r.randint(60, 140))) for _ in range(12)] + ["# Draft\n\n" + sentence(r) + "\n<!-- " + "\n".join(phrases(r, 120)) + " -->" for _ in range(6)]
    bad += [" ".join("#" + p.replace(" ", "_") for p in phrases(r, 40)) for _ in range(4)] + [links(r, 15, False) for _ in range(6)]
    bad += ["\n".join(f"{n.title()} XL SKU-{r.randint(1, 9999)} {r.randint(1, 99)}.99" for n in r.choices(NOUNS, k=40)) for _ in range(4)]
    return sound, bad


def test_found(spark, corpus):
    sound, bad = corpus
    rows = [(i, t, r, "x") for i, (t, r) in enumerate([*((t, "markdown") for t in sound), *((t, None) for t in bad)])]
    extra = [(10_000, None, "text", "x"), (10_001, "", "text", "x"), (10_002, "ab " * 900, "text", "x"), (10_003, "word", None, "x"), (10_004, bad[0], "python", "copy"), (10_005, "z" * 300_000, None, "x"), (10_006, "https://a.example/x https://a.example/y", None, "x")]
    df = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string, reason string")
    found = spam.spam(df).collect()
    by_id = {}
    for f in found:
        by_id.setdefault(f.doc_id, set()).add(f.reason)
    assert set(by_id) == {*range(len(sound), len(rows)), 10_004}
    assert by_id[10_004] == by_id[len(sound)] and {r for rs in by_id.values() for r in rs} == {"curve", "words", "links"}


def test_curves_of_prose_and_code_are_judged(spark, corpus):
    """Stuffed sentences and lists rich in signs leave the curve of their kind; repetitive code and prose without the words do not count."""
    sound, bad = corpus
    stuffed = " ".join(f"the best {noun} for you is the {noun} of the day in this and that way" for noun in NOUNS * 5)
    signs = "\n".join(["/* 10 */ | cheap tile saw | {bu} [de] (fo) <gu> {zu} [va] (wo) <xi> $ye; zo_ra = ti_le"] * 45)
    repetitive = ["\n".join(["const late: [u8; 4] = [0xa9, 0x9e, 0xfb, 0x8f];"] * 90), " ".join(["the notes of this and that are kept as they were for all of us here"] * 40)]
    rows = [(i, t, "markdown") for i, t in enumerate([*sound, *bad, stuffed, signs, *repetitive])]
    found = spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    n = len(sound) + len(bad)
    assert {f.doc_id for f in found} == set(range(len(sound), n + 2))
    assert {"curve"} <= {f.reason for f in found if f.doc_id in (n, n + 1)}


def test_many_topics(spark):
    """Words of topics that each are on a hundredth of the extreme pages are learned, also from pages with many distinct words."""
    r = random.Random(7)
    topics = [["".join(r.choices("bdfgklmnprst", k=1)[0] + r.choice("aeiou") for _ in range(4)) for _ in range(8)] for _ in range(100)]
    sound = [prose(r, r.randint(3, 25)) for _ in range(150)] + [code(r, r.randint(3, 40)) for _ in range(60)]
    stuffed = [", ".join(" ".join(r.sample(t, 3)) for _ in range(r.randint(20, 60))) for t in topics for _ in range(4)]
    tags = [" ".join("#" + "".join(r.sample(t, 2)) for _ in range(12)) for t in topics]
    rows = [(i, t, "markdown") for i, t in enumerate(sound + stuffed + tags)]
    found = spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert {f.doc_id for f in found} == set(range(len(sound), len(rows)))


@pytest.mark.parametrize("broadcast", [0, 100])
def test_made_up_words(spark, monkeypatch, broadcast):
    monkeypatch.setattr(spam, "BROADCAST_WORDS", broadcast)
    words = spark.createDataFrame([("garage",), ("door",), ("doors",), ("x",), ("жар",)], "word string")
    seen = ["garagedoor", "doorsdoor", "garagexdoor", "garagedoorz", "doordoorsgarage", "жаржаржар", "door", "zzgarage"]
    vocabulary = spark.createDataFrame([(w, 1) for w in seen * 2], "word string, total bigint")
    assert sorted(r.word for r in spam.made_up(vocabulary, words).collect()) == sorted(["garagedoor", "doorsdoor", "doordoorsgarage", "жаржаржар"])
    assert spam.made_up(vocabulary, words.limit(0)).count() == 0


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert spam.spam(df).count() == 0
    one = spark.createDataFrame([(1, "A short note about a table.", None)], "doc_id bigint, text string, lang string")
    assert spam.spam(one).count() == 0


def test_counts():
    p = spam.Pages(pa.array(["Near-me near ME, it's https://near.example/me?x=1 {1}", None, "", "ж Ж", "<p>see</p> [a b](https://x.example) 東京 <a href='https://y.example/z'>c</a>"]))
    page, word, count = p.counts()
    got = {(int(a), p.vocabulary[b]): int(c) for a, b, c in zip(page, word, count)}
    assert got == {(0, "near"): 2, (0, "me"): 2, (0, "it"): 1, (0, "s"): 1, (0, spam.LINK): 1, (3, "ж"): 2, (4, "see"): 1, (4, "東"): 1, (4, "京"): 1, (4, spam.LINK): 2}
    assert p.links.tolist() == [1, 0, 0, 0, 2] and p.code.tolist()[:4] == [3, 0, 0, 0] and p.chars.tolist()[:4] == [53, 0, 0, 3]
    assert p.words.tolist() == [7, 0, 0, 2, 5]
    assert spam.Pages(pa.array([], pa.string())).words.tolist() == [] and spam.Pages(pa.array([None], pa.string())).words.tolist() == [0]


def test_tongues():
    texts = ["the cat is on the mat and it is not for you", "der Hund und die Katze sind nicht in dem Haus", "le chat est dans la maison et il ne dort pas", "собака и кошка не в доме, но они на дворе", "我们在这里的人不是他们的", "これはペンではありません"]
    p = spam.Pages(pa.array(texts))
    assert p.tongue.tolist() == ["en", "de", "fr", "ru", "zh", "ja"]
    assert (p.function >= spam.PROSE * p.words).all()


def test_links():
    text = "see https://a.example/x?y=1, www.b.test or c-d.example/q | e.f.invalid; not regex.test(x), a.b, me@x.example, 3.com=1, self.example_x or /p/x.example"
    assert [text[a:b] for a, b in spam.find_links(text)] == ["https://a.example/x?y=1,", "www.b.test", "c-d.example/q", "e.f.invalid"]
    assert len(spam.find_links("")) == 0


def test_anchors():
    pages = ["[a b](https://x.example) and [c] (d) https://y.example", "<a href='https://z.example/q'>e f</a> g [url=http://u.example]h[/url] <A HREF=https://w.example>i</A>", "<a href=https://v.example>open", "no end here</a>", "[k\n](https://t.example)"]
    text = "\n".join(pages)
    starts = spam.np.cumsum([0, *(len(p) + 1 for p in pages[:-1])])
    got = [text[a:b] for a, b in spam.anchored(text, spam.find_links(text), starts)]
    assert got[:2] == ["[a b](https://x.example", "https://y.example"]
    assert got[2:5] == ["<a href='https://z.example/q'>e f</a>", "[url=http://u.example]h[/url]", "<A HREF=https://w.example>i</A>"]
    assert got[5:] == ["https://v.example", "https://t.example"]


def test_other_languages(spark, corpus):
    """Stuffing in other languages and in scripts without blanks is found; prose in them is not."""
    sound, bad = corpus
    r = random.Random(11)
    german = ["billig garage tor kaufen", "garage tor angebot", "bestes garage tor rabatt", "garage tor online shop", "preis vergleich garage tor"]
    chinese = ["便宜车库门购买", "车库门优惠", "官方车库门折扣", "车库门批发价格"]
    prose_de = ["Der Puffer wird erst dann geleert, wenn die Tabelle gelesen ist, und nicht vorher, weil sonst Zeilen verloren gehen.", "Wir warten auf den nächsten Block, denn es ist nicht bekannt, ob er noch mit dem alten Schlüssel kommt.", "Für jede Spalte gibt es eine Datei, die auch von anderen gelesen werden kann.", "Das Fenster ist so groß wie die Matrix und kann nach dem Start nicht mehr wachsen.", "Im Zweifel gilt die Regel, dass der ältere Eintrag aus dem Speicher fällt."]
    prose_zh = "我们在读完表格之后才会清空缓冲区，因为这样不会丢失任何一行数据。每一列都有自己的文件，其他程序也可以读取它。窗口的大小和矩阵一样，启动以后不能再变大。如果有疑问，就把比较旧的记录从内存里删除。"
    stuffed = [", ".join(r.choices(german, k=50)), "".join(r.choices(chinese, k=60)), "便宜车库门购买官方" * 60]
    fine = [" ".join(r.sample(prose_de, 5)), prose_zh]
    rows = [(i, t, "markdown") for i, t in enumerate([*sound, *bad, *stuffed, *fine])]
    found = {f.doc_id for f in spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    n = len(sound) + len(bad)
    assert found == set(range(len(sound), n + len(stuffed)))


def test_a_part_of_the_corpus_gives_the_same_verdicts(spark, corpus):
    """Verdicts do not hang on the size of the corpus."""
    sound, bad = corpus
    rows = [(i, t, "markdown") for i, t in enumerate([*sound, *bad])]
    whole = {f.doc_id for f in spam.spam(spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string")).collect()}
    half = {f.doc_id for f in spam.spam(spark.createDataFrame(rows[::2], "doc_id bigint, text string, lang string")).collect()}
    assert whole == set(range(len(sound), len(rows))) and half == {i for i in whole if i % 2 == 0}
