import hashlib
from html.parser import HTMLParser

import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import chat_format as C
from seqloom.llm import html_crf as H
from seqloom.llm.bpe_monoid import Codec

PATH = P.path("byte_bpe_50k.tiktoken")
PIECES = st.sampled_from(["<", "/s>", "[", "INST]", "\\", "s>", "|turn|>", "|end|>", *C.CONTROL, " x", "é"])


@settings(max_examples=500, deadline=None)
@given(st.lists(PIECES, max_size=9).map("".join))
def test_escapes_are_exact_and_complete(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=5).map("".join), st.sampled_from(["user", "assistant", "", "</s>"]))
def test_turns_read_back(text, role):
    a = C.assembler(Codec.of(PATH, P.PATTERN))
    ids, mask = a.turn(role, text)
    assert a.read(ids) == [(role, text)]
    assert a.back(ids, mask) == [(role, text, text if role == "assistant" else "", len(a.written(ids)))]
    if text:
        part = [False] * len(ids)
        part[-2] = True  # the text's last token alone
        assert a.back(ids, part)[0][2] == a.learned_text(ids, part)
    assert a.learned_text(ids, mask) == (text if role == "assistant" else "")
    assert len(ids) == len(mask) and a.written(ids) == f"<|turn|>{C.escape(role)}<|text|>{C.escape(text)}<|end|>"


def test_conversations(spark):
    rows = [(1, 0, "user", "hi", 9), (1, 1, "assistant", "</s>[INST] ok", 9), (1, 1, "assistant", "</s>[INST] ok", 9), (2, 5, None, None, 9), (None, 0, "assistant", "x", 9), (1, None, "system", "s", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in C.digest_conversations(C.format_turns(df, PATH, P.PATTERN), PATH, P.PATTERN, formatted=True).collect()}
    assert {r.conv_id: r for r in C.digest_conversations(df, PATH, P.PATTERN).collect()} == got
    assert C.digest_conversations(df.limit(0), PATH, P.PATTERN).count() == 0
    said = "system\ns\nuser\nhi\n" + "assistant\n</s>[INST] ok\n" * 2
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 26 and got[1].loss_sha256 == hashlib.sha256(b"</s>[INST] ok" * 2).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 1
    assert C.digest_conversations(C.format_turns(df.limit(0), PATH, P.PATTERN), PATH, P.PATTERN, formatted=True).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy this.</div><article><h1>Title &amp; more</h1><p><b>First  part,\n of it.<br><p>Second&nbsp;one with enough words to be text.</p>'
    '<div class="comments"><p>Nice article, thanks for it.</p></div></article><footer>&copy; site</footer></body></html>'
)


def test_a_page():
    f = H.trained()
    assert f.extract(PAGE) == "Title & more First part, of it. Second one with enough words to be text."
    assert f.extract("") == "" and f.extract("<script>only()") == ""


class Plain(HTMLParser):
    """All text that isn't hidden, by another parser."""

    VOID = {"br", "img", "hr", "input", "meta", "link"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.append(tag)
        elif not self.hidden and tag in H.RAW | H.HIDDEN:
            self.hidden.append(tag)
        elif not self.hidden and (tag in H.BLOCK or tag == "br"):
            self.out.append(" ")

    def handle_startendtag(self, tag, attrs):
        if tag != "svg":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
        elif not self.hidden and tag in H.BLOCK:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def plainly(page):
    p = Plain()
    p.feed(page)
    p.close()
    return "".join(p.out).split()


PARTS = ["<p>", "</p>", "<b>", "</b>", "one &amp; two ", "x&lt;y", "<div class='a>b'>d</div>", "<svg width='1'/>", "<svg><g><svg></svg></g> no </svg>", "<datalist id=d><option value='a'><option>no</datalist>", '<script>if (a < b) "<!-- x";</script>', "<!-- no <p> -->", "<!---->", "<br>", "<ul><li>i<li>j</ul>", "<math><mi>x</mi></math>", "&eacute;", "<select><option>no</select>", "<style>p{}</style>", "word ", " <i>in</i>line ", "<template><p>no</p></template>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_blocks_hold_the_text_that_another_parser_finds(page):
    assert " ".join(t for t, _, _ in H.leaf_blocks(page)).split() == plainly(page)


def test_nothing_behind_odd_markup_is_lost():
    f, rest = H.trained(), "<p>This is the rest of it, long enough to be read.</p></article>"
    for odd in ("<svg width=1/>", "<svg>", "<datalist><option value='a'></datalist>", "<option value='a'>", '<script>var x = "<!-- x";</script>', "<button>", "<!-->", "<video src=x>", "<object>"):
        assert f.extract(f"<article><h1>Title</h1><p>First part of it, here.</p>{odd}{rest}") == "Title First part of it, here. This is the rest of it, long enough to be read.", odd
    assert f.extract("<article><p>Fish &<b>amp;</b> chips, as they say.</p></article>") == "Fish &amp; chips, as they say."
    assert "<p>" not in f.extract("<article><p>One <!-- <p>x</p> --> two, and more of it.</p></article>")


def test_features_read_whole_blocks():
    page = lambda t: H.leaf_blocks(f"<p>{t}</p>")[0][2]
    bit = lambda name: 1 << H.TEXT_BITS.index(name)
    assert page("word " * 100 + "7 " * 900) & bit("digits") and not page("7 " * 100 + "word " * 900) & bit("digits")
    assert page("word " * 100 + "all rights reserved") & bit("rights_in_long") and page("all rights reserved") & bit("rights_in_short")


def test_field_generalises_to_unseen_layouts():
    f, wrong, n = H.trained(), 0, 0
    for page, labels in H.labelled_pages(150, 99):
        blocks = H.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(int(x) != y for x, y in zip(f.decode(blocks), labels, strict=True))
        n += len(labels)
    assert wrong < 0.02 * n


def test_viterbi_is_the_best_path():
    from itertools import product

    f = H.trained()
    blocks = H.leaf_blocks(PAGE)[:8]
    score = lambda y: f.first[y[0]] + sum(f.emission(b[1], b[2]) for b, k in zip(blocks, y, strict=True) if k) + sum(f.moves[a, b] for a, b in zip(y, y[1:], strict=False))
    assert max(product((0, 1), repeat=len(blocks)), key=score) == tuple(map(int, f.decode(blocks)))


def test_rows_and_broken_pages(spark):
    deep = "<div>" * 3000 + "<p>Deep text, quite deep.</p>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (3, "u", PAGE[:300]), (4, "u", deep), (5, "u", "<p " + "'" * 999), (6, "u", "<article><p>" + "long text. " * 50_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert len(got) == len(rows) and all(len(r.text) == r.n_chars for r in got)
    assert {r.page_id: r.n_chars for r in got}[6] == len("long text. " * 50_000) - 1
    assert H.extract(df.limit(0)).count() == 0
