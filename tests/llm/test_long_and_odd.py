"""Long texts, odd markup, recall of lines, and what the passes over blocks decide."""

import random
import time

import numpy as np
import pytest

LONG = {"spaces": " " * 1_000_000, "line feeds": "\n" * 1_000_000, "both": "a" + " \n" * 400_000 + "b", "tail": "x" + "\t" * 300_000, "no space": "ab" * 1_000_000, "lines": "some line\n" * 100_000}


@pytest.mark.parametrize("kind", sorted(LONG))
def test_long_texts_encode_as_the_library_does(kind):
    import public_tokenizers
    import tokenizers

    from tessera.llm.bpe import Tokenizer, chunk_cuts, safe_places

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    with open(path, encoding="utf-8") as f:
        mine = Tokenizer(f.read())
    text = LONG[kind]
    data = np.frombuffer(text.encode(), np.uint8)
    ids = mine.encode(data, chunk_cuts(data), safe_places(data))
    assert ids.tolist() == tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == text


def test_long_texts_pass_every_operator_on_rows(spark):
    from tessera.llm import decontamination, line_dedup, quality_rules, substring_dedup

    docs = spark.createDataFrame([*enumerate(LONG.values()), (90, None), (91, "")], "doc_id long, text string")
    assert line_dedup.line_dedup(docs).filter("lines_left > 0").count() == 4  # lines, no space, both's one line less, tail
    assert substring_dedup.substring_dedup(docs, size=35).filter("n_removed > 0").count() == 1
    assert quality_rules.text_counts(docs).filter("n_words > 0").count() == 4
    bench = spark.createDataFrame([("i", "some line some line some line some line")], "item_id string, text string")
    assert decontamination.benchmark_matches(docs, bench).filter("size(items) > 0").count() == 1


def test_signatures_find_similar_lines():
    """At the threshold at least 99 of 100 pairs share a band, above it more."""
    from tessera.llm import sketch
    from tessera.llm.line_dedup import HASHES, ROWS, _shingles, _signatures

    draw = random.Random(2)
    near = {0.8: [], 0.9: []}
    while min(map(len, near.values())) < 300:
        words = ["".join(draw.choice("abcdefghijklmnop é") for _ in range(7)) for _ in range(draw.choice([8, 20, 60]))]
        other = list(words)
        for _ in range(draw.choice([1, 1, 2, 3])):
            other[draw.randrange(len(other))] = "".join(draw.choice("qrstuvw") for _ in range(draw.choice([1, 3, 7])))
        a, b = " ".join(words).encode(), " ".join(other).encode()
        x, y = set(_shingles(a).tolist()), set(_shingles(b).tolist())
        j = len(x & y) / len(x | y)
        for least, found in near.items():
            if least <= j < least + 0.05 and len(found) < 300:
                found.append((a, b))
    for least, pairs in near.items():
        lines = [x for pair in pairs for x in pair]
        keys = sketch.bands(_signatures(lines, np.arange(len(lines))), ROWS)
        assert keys.shape[1] == HASHES // ROWS
        assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= (0.99 if least == 0.8 else 1.0)


def test_a_shingle_is_its_characters():
    from tessera.llm.line_dedup import _shingles

    for text in ("plain ascii text", "déjà vu straße", "mixed 中文 and ascii text", "short"):
        runs = [text[k : k + 8] for k in range(len(text) - 7)]
        got = _shingles(text.encode()).tolist()
        assert len(got) == len(runs)
        whole = _shingles(("x" + text + "€ends here").encode()).tolist()[1 : 1 + len(runs)]
        assert got == whole  # whatever stands around it
        assert len(set(got)) == len(set(runs))


ARTICLE = "<p>" + "The house at the end of the road is old and it is known to all of the people who live in the village. " * 2 + "</p>"


@pytest.mark.parametrize(
    "inside, text",
    [
        ('<div class="search-algorithms">{}</div>', True),
        ('<section id="related-work">{}</section>', True),
        ('<section id="related">{}</section>', False),
        ('<div class="comment-list">{}</div>', False),
        ('<div class="has-sidebar">{}</div>', True),
        ("<nav>{}</nav>", False),
        ("<form>{}</form>", False),
        ("<object>{}</object>", True),
    ],
)
def test_parts_of_an_article(inside, text):
    from tessera.llm.html_text import main_text

    own = "<p>It is told that the tower was built by the two brothers and that they were never paid for the work on it.</p>"
    got = main_text(f"<html><body><article>{ARTICLE}{inside.format(own)}{ARTICLE}</article></body></html>")
    assert ("two brothers" in got) is text and got.count("village") == 4


def test_densities_and_neighbours_decide():
    from tessera.llm import html_text as H

    links = '<div><a href="1">Home of the news</a> <a href="2">All of the sport in the town and around it</a> <a href="3">Weather for the day and the week</a></div>'
    menu = "<div>Alpha Bravo Charlie Delta Echo Foxtrot Golf Hotel India Juliett Kilo Lima Mike November Oscar</div>"
    page = f"<body>{links}{menu}<h2>A heading</h2>{ARTICLE}<div>A caption</div>{ARTICLE}{menu}<div>Short tail</div>{menu}</body>"
    got = H.main_text(page).split("\n")
    assert [x[:9] for x in got] == ["The house", "A caption", "The house"]
    found = H.blocks(page)
    assert [H.first_pass(b, False) for b in found] == [False, False, None, True, None, True, False, None, False]
    hinted = f'<article>{ARTICLE}<div class="search-tips">{menu[5:-6]}</div></article>'
    assert "Charlie" not in H.main_text(hinted) and "Charlie" in H.main_text(hinted.replace("search-tips", "tips"))


def test_open_quotes_and_deep_markup():
    from tessera.llm.html_text import main_text

    assert main_text(f'<article>{ARTICLE}<p>see <a href="x>the link</a> and <b title="a > b">more</b></p></article>').endswith("see the link and more")
    for page in ("<div>" * 100_000 + "x", '<a "' * 100_000 + "x", '<b>"x' * 100_000, "<p>" * 100_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 10
