"""What stays as it is: nested and unclosed elements, foreign content, and characters that serve as internal marks."""

from glyphmill.operators.protect import elements, templates
from glyphmill.operators.reserved import scrubbed
from glyphmill.plans.config import Config
from glyphmill.plans.engine import DocumentError, Typesetter


def run(text, groups=(), tags=(), blocks=(), **config):
    return Typesetter(Config(**config), groups, tags, blocks).plan().typeset(text)


def spans(text, document=True):
    return [text[a:b] for a, b, _ in elements(text, (), False, document)]


def test_element_scan():
    assert spans("a <code>1<code>2</code>3</code> b") == ["1<code>2</code>3"]
    assert spans("a <script>1<script>2</script>3 b") == ["1<script>2"]
    assert spans('<a title="<code>">x</a> <pre>p') == ["p"]
    assert spans("x <!-- <pre> --> y") == [] and spans("x <!-- <pre> y") == [" <pre> y"]
    assert spans('x <b title="1>2 y') == ['<b title="1>2 y'] and spans("1 < 2") == []
    assert spans("<notg><pre></notg> x") == [] and spans("a <pre>b", document=False) == []
    assert spans("<pre>1<code>2</pre>3</code> 4") == ["1<code>2"]
    assert spans("<script><!-- </script> 1") == ["<!-- "]


def test_foreign_content():
    assert spans("<svg><samp/>a <script>1</script></svg> b") == ["1"]
    assert spans("<svg><style>x<samp>y</samp></style></svg>") == ["x<samp>y</samp>"]  # not raw there, so the pair is found as a pair
    assert spans("<svg><div><samp/>a</div>") == ["a</div>"]  # div leaves foreign content, where a slash ends nothing
    assert spans("<svg><foreignObject><samp/>a</foreignObject></svg>") == ["a</foreignObject></svg>"]


TAILS = ["<pre>5-6  -  7 ", "<code>5-6  -  7", "<script>5-6\n\n\n  -  7", "<!-- 5-6  -  7", '<b title="5-6  -  7']


def test_open_and_nested_elements_stay():
    rules = {"*": False, "number.en_range": True, "space.collapse_spaces": True}
    for t in TAILS:
        assert run("5-6  к " + t, rules=rules) == "5–6 к " + t
        assert run("5-6  к " + t, html=True, rules=rules | {"text.paragraphs": True}).endswith(t)
    assert run("<code>5-6<code>1-2</code>3-4</code> 5-6", rules=rules) == "<code>5-6<code>1-2</code>3-4</code> 5–6"


def test_reserved_characters_stay():
    rules = {"*": False, "punctuation.repeat_limit": True}
    assert run("a\ue100 b\ue101 c!! d??", rules=rules) == "a\ue100 b\ue101 c! d?"
    for t in ("<!-- x --> \ue000H0\ue001 \ue000N0\ue001 \ue000B0\ue001 <code>y</code>", "\ue002 \ue000 \ue003", "<b>x</b> <\ue000T0\ue001>"):
        assert run(t, rules=rules) == t
    for c in range(0xE000, 0xF900, 37):
        assert run(f"а {chr(c)} - б", rules=rules) == f"а {chr(c)} - б"
    try:
        run("".join(chr(c) for c in range(0xE000, 0xF900)))
        raise AssertionError
    except DocumentError as e:
        assert e.code == "INPUT"


def test_placeholders_of_sequences_cannot_be_forged():
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    for t in (f"AuSAFE0TK AuSAFEq0TK и {uuid}", "http://glyphmill-xyz/A0SAFEq0ID и http://a.ru/x-y", "A1SAFEq0ID@glyphmill.xyz x@a.ru", "::1 и AvSAFEq0TK"):
        assert run(t, rules={"*": False}) == t


def test_own_groups_keep_what_they_were_given():
    mark, brk = "\ue000T1\ue001", "\ue100BR\ue101"
    assert scrubbed(f"a <{mark}>{brk}", f"{brk}<{mark}> b <{mark}>{brk}\ue100c\ue000Z9\ue001") == f"{brk}<{mark}> b <>c"


def test_many_blocks_of_the_users_own():
    blocks = tuple((f"[[{k}:", f":{k}]]") for k in range(15)) + (("/#\\d+</", "/>/"),)
    text = "5-6 " + " ".join(f"[[{k}:5-6:{k}]]" for k in range(15)) + " #12<5-6>"
    assert run(text, blocks=blocks, rules={"*": False, "number.en_range": True}) == "5–6" + text[3:]
    assert run("<note>5-6</note> <note/> 5-6", tags=("note",), rules={"*": False, "number.en_range": True}) == "<note>5-6</note> <note/> 5–6"


def test_templates_of_all_dialects():
    cases = {"handlebars": "{{{ 5-6 }}} {{!-- 5-6 }} --}} {{ a '}}' 5-6 }}", "mustache": "{{{5-6}}} {{5-6}}", "twig": "{# 5-6 #} {% a \"%}\" 5-6 %}", "jinja": "{{ 5-6 }}", "nunjucks": "{% 5-6 %}", "liquid": "{{ 5-6 }}", "erb": "<%= 5-6 %>"}
    for dialect, text in cases.items():
        assert run(text + " 5-6", template=dialect, rules={"*": False, "number.en_range": True}) == text + " 5–6", dialect
    assert templates("{{ " + "x" * 9000 + " }}", "jinja") == []


def test_more_than_a_million_tags():
    text = "<b></b>" * 520_000 + " 5-6"
    got = run(text, max_input_length=5_000_000, rules={"*": False, "number.en_range": True})
    assert got == text[:-3] + "5–6"


def test_restore_reaches_marks_inside_marks():
    assert run("<a href='http://a.ru/<code>x</code>'>y</a> <notg>a <code>5-6</code> <b>5-6</b></notg>", rules={"number.en_range": True}) == "<a href='http://a.ru/<code>x</code>'>y</a> a <code>5-6</code> <b>5-6</b>"
