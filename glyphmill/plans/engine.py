"""The typesetter: a configuration compiled once into one function over texts, and that function as a projection over any DataFrame, batch or streaming.

A text goes through marks for what stays, decoding, the enabled rule groups, encoding and the restoring of marks. All of it happens in one Arrow function, because a native chain of these
rules (some 400 regular expressions, each with its guard) was measured 40 times slower: every native step crosses between two string encodings, and guards that keep a
value bound run outside generated code. The projection is narrow and deterministic: there is no shuffle, filters and column pruning pass it, and batch and stream share it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diff, glyphs
from ..functions.rx import OPEN, SPACES, Step, guarded
from ..operators import layout, markup, protect, quotes, reserved
from ..operators.rules import GROUPS, RULES, Context
from ..ship import ship
from ..sources import scan, structured
from .config import Config


@dataclass(frozen=True)
class RuleGroup:
    """A group of the user's own: handlers from text and context to text, set before or after a built-in group ("start", "end", "before:x", "after:x").

    What they return may hold no marks that they weren't given. A handler that takes one argument gets the text alone.
    """

    name: str
    steps: tuple[Callable[..., str], ...]
    position: str = "end"


class DocumentError(ValueError):
    """Why a document has no result: a code and a message."""

    def __init__(self, code: str, message: str):
        self.code = code
        super().__init__(message)


def _handler(step: Callable[..., str], ctx: Context) -> Step:
    code = getattr(step, "__code__", None)
    return (lambda t: step(t, ctx)) if code is not None and code.co_argcount == 2 else step


class Plan:
    """A configuration as a function over texts. It is made where it runs; what travels is the configuration."""

    def __init__(self, config: Config, order: tuple, safe_tags: tuple[str, ...], safe_blocks: tuple[tuple[str, str], ...]):
        self.config, self.order, self.safe_tags, self.safe_blocks = config, order, safe_tags, safe_blocks
        enabled = config.enabled()
        self.ctx = ctx = replace(config.context(), enabled=enabled)
        self.before_text: list[tuple[Step, bool]] = []
        self.text_group: list[tuple[Step, bool]] = []
        self.after_text: list[tuple[Step, bool]] = []
        current = self.before_text
        run: list = []

        def close(target: list) -> None:
            if run:
                target.append((guarded(run), False))
                run.clear()

        for group in order:
            if isinstance(group, RuleGroup):
                close(current)
                current += [(_handler(s, ctx), True) for s in group.steps]
                continue
            if group == "text":
                close(current)
                current = self.text_group
            if group == "quote":
                on = frozenset(r.split(".")[1] for r in enabled if r.startswith("quote."))
                if on:
                    run.append(((frozenset('"«»'),), lambda t, on=on: quotes.typeset_quotes(t, on, ctx.nested, ctx.inch)))
            else:
                run += [r.step(ctx) for r in RULES if r.group == group and r.id in enabled]
            if group == "text":
                close(current)
                current = self.after_text
        close(current)
        self.blocks = [protect.own_block(a, b) for a, b in safe_blocks]
        self.fields = structured.Selectors(config.fields) if config.fields else None
        self.exclude = structured.Selectors(config.exclude) if config.exclude else None
        self.lays_out = ctx.html and bool({"text.paragraphs", "text.breakline"} & enabled)
        steps = self.before_text + self.text_group + self.after_text
        self.steps = [step for step, _ in steps]
        # whether texts that hold nothing to mark need the steps alone, and whether those at hand are such texts
        self.can_be_plain = not (self.lays_out or config.template or safe_blocks or config.max_processing_ms or config.format in ("markdown", "frontmatter", "xml") or any(own for _, own in steps))
        self.plain = False
        # steps of the user's own and a time budget may do otherwise with the same text
        self.values: dict | None = None
        self.repeats = not (config.max_processing_ms or any(own for _, own in steps))

    # --- many texts ---
    def typeset_all(self, texts: list[str | None]) -> tuple[list, list, list]:
        """Typeset texts, codes and messages. What marks are made for is looked for in a stretch of texts at once, and equal short texts are done once."""
        out, codes, messages = [], [None] * len(texts), [None] * len(texts)
        typeset, done = self.typeset, {}
        for at in range(0, len(texts), _STRETCH):
            stretch = texts[at : at + _STRETCH]
            if self.repeats and (self.values is None or len(self.values) > _KEPT):
                self.values = {}
            self.plain = self.can_be_plain and _nothing_to_mark("\n".join([t for t in stretch if t]), self.config.format in scan.SCANNERS)
            for k, text in enumerate(stretch, at):
                if text is None or self.repeats and (new := done.get(text)) is not None:
                    out.append(None if text is None else new)
                    continue
                try:
                    new = typeset(text)
                    if self.repeats and len(text) <= _SHORT:
                        done[text] = new
                except DocumentError as e:
                    new, codes[k], messages[k] = None, e.code, str(e)
                out.append(new)
        self.plain, self.values = False, None
        return out, codes, messages

    # --- one text ---
    def fragment(self, text: str, destination: str, trim: Callable[[str], str] | None, deadline: float) -> str:
        """Marks to restored text. Destinations: html, markdown, xml, value."""
        cfg, html = self.config, self.ctx.html and destination in ("html", "markdown")
        if self.plain and text.count(":") < 7:
            for step in self.steps:
                text = step(text)
            if cfg.entities and destination != "value":
                text = glyphs.encoded(text)
            if html and OPEN in text:
                text = layout.emitted(text, cfg.layout(), self.ctx.nowrap, self.ctx.prefix)
            return trim(text) if trim else text
        text, back = reserved.escaped(text)
        frame, sequences = protect.Frame(), None
        if protect.may_hold_sequences(text):  # most texts hold none, and a short one is done sooner than its marks are made
            sequences = protect.Sequences(text)
            text = sequences.masked(text)
        tagged = destination != "value" and "<" in text and bool(protect.HAS_TAG.search(text))
        if destination == "markdown":
            text = markup.mask_markdown(text, frame, cfg.template, self.safe_tags)
        else:
            if "<" in text:
                text = frame.cover(text, protect.elements(text, self.safe_tags, destination == "xml", destination == "html"))
            if destination == "xml":
                text = markup.mask_xml(text, frame)
            if destination == "html" and tagged:
                text = frame.cover(text, protect.comments(text))
            if cfg.template:
                text = frame.cover(text, protect.templates(text, cfg.template))
        for scan_block in self.blocks:
            text = frame.cover(text, scan_block(text))
        if destination == "html":
            text = frame.cover(text, protect.indents(text))
        if "<" in text:
            text = protect.tag_masked(protect.notg(text, frame), frame)
        text = glyphs.line_ends(glyphs.decoded(text))
        self.ctx.now[0] = frame
        if destination == "html" and "W" in frame.held:
            text = protect.lifted(text)
        if html and self.lays_out:
            text = layout.lift_paragraphs(text, frame.tag_names())
        text = self._run(self.before_text, text, deadline)
        if destination == "html" and "W" in frame.held:
            text = protect.settled(text, frame)
        if self.text_group:
            text = self._run(self.text_group, text, deadline)
        if self.after_text:
            text = self._run(self.after_text, text, deadline)
        if cfg.entities and destination != "value":
            text = glyphs.encoded(text, destination == "xml")
        if html:
            text = layout.emitted(text, cfg.layout(), self.ctx.nowrap, self.ctx.prefix)
            text = layout.restore_paragraphs(frame.restored(text, "IH"))
        elif frame.held:
            text = frame.restored(text, "IH")
        if OPEN in text:
            text = frame.tags_restored(text)
        if html:
            text = layout.unwrap(text)
        if trim:
            text = trim(text)
        if frame.held:
            text = frame.restored(text, "BNEFW")
        if sequences:
            text = sequences.restored(text)
        return text.translate(back) if back else text

    def _run(self, steps: list[tuple[Step, bool]], text: str, deadline: float) -> str:
        for step, own in steps:
            if deadline != _NEVER and time.monotonic() > deadline:
                raise DocumentError("BUDGET", f"not done within {self.config.max_processing_ms} ms")
            new = step(text)
            text = reserved.scrubbed(text, new) if own else new
        return text

    def typeset(self, text: str) -> str:
        """The typeset text; raises DocumentError where there is none."""
        cfg = self.config
        if len(text) > cfg.max_input_length or len(text) * 2 > cfg.max_input_length and glyphs.units(text) > cfg.max_input_length:
            raise DocumentError("INPUT", "input too long")
        limit = cfg.max_processing_ms
        deadline = time.monotonic() + limit / 1000 if limit else _NEVER
        try:
            return self._document(text, deadline)
        except (scan.ScanError, reserved.Exhausted) as e:
            raise DocumentError("INPUT", str(e)) from None

    def _document(self, text: str, deadline: float) -> str:
        fmt = self.config.format
        if fmt in scan.SCANNERS:
            return self._values(text, fmt, deadline)
        if fmt == "frontmatter":
            parts = structured.split_frontmatter(text)
            if parts is None:
                return self._markdown(text, deadline)
            kind, head, header, close, body = parts
            return head + self._values(header, "yaml" if kind == "---" else "toml", deadline) + close + self._markdown(body, deadline)
        if fmt == "xml":
            if problem := scan.validate_xml(text):
                raise scan.ScanError(problem)
            core = text.strip(SPACES)
            head = len(text) - len(text.lstrip(SPACES)) if core else 0
            return text[:head] + self.fragment(core, "xml", None, deadline) + text[head + len(core) :] if core else text
        if fmt == "markdown":
            return self._markdown(text, deadline)
        if text[:1] not in _SPACES:
            return self.fragment(text, "html", protect.trimmed, deadline)
        m = _FIRST_INDENT.match(text)  # the indent of the first line with content is put back after the trim; those of the other lines are masked
        indent = m[2] if m else ""
        done = self.fragment(m[1] + text[m.end() :] if m else text, "html", protect.trimmed, deadline)
        return indent + done if done else done

    def _values(self, text: str, fmt: str, deadline: float) -> str:
        return structured.typeset_document(text, fmt, self.fields, self.exclude, lambda v: self.fragment(v, "value", None, deadline), self.values if len(text) <= _SHORT else None)

    def _markdown(self, text: str, deadline: float) -> str:
        return _BLANK_EDGES.sub("", self.fragment(text, "markdown", None, deadline))


#: Texts that are looked at together, and the longest of which the result is kept while its batch lasts.
_STRETCH, _SHORT = 256, 1000
#: Fixed value: values of short structured documents beyond which those known so far are forgotten.
_KEPT = 10_000


def _nothing_to_mark(t: str, escapes: bool) -> bool:
    """Whether texts, a line apart, have no markup, entity, address, identifier, indent or character to fold or escape, behind no escape but that of a quote, but for identifiers of more than six colons."""
    if "<" in t or "&" in t or "@" in t or "\r" in t or "\n\n\n" in t or "::" in t or escapes and "\\" in t and t.count("\\") != t.count('\\"') or reserved.held(t) or glyphs.folds(t):
        return False
    return not ((":" in t or "." in t) and protect.url_likely(t) or "-" in t and protect.uuid_likely(t) or not escapes and (t[:1] in (" ", "\t") or "\n " in t or "\n\t" in t))


_NEVER, _SPACES = float("inf"), frozenset(SPACES) | {""}
_FIRST_INDENT = re.compile(rf"((?:[{SPACES}]*[\n\r])?)([ \t]*)(?=[^{SPACES}])")
_BLANK_EDGES = re.compile(r"\A(?:[ \t]*\n)+|(?:\n[ \t]*)+\Z")


class Typesetter:
    def __init__(self, config: Config | None = None, groups: tuple[RuleGroup, ...] = (), safe_tags: tuple[str, ...] = (), safe_blocks: tuple[tuple[str, str], ...] = ()):
        self.config = config or Config()
        self.enabled = self.config.enabled()
        for t in safe_tags:
            if not re.fullmatch(r"[a-zA-Z][\w.:-]*", t):
                raise ValueError(f"{t!r} is no tag name")
        self.safe_tags, self.safe_blocks = tuple(safe_tags), tuple(safe_blocks)
        order: list[str | RuleGroup] = list(GROUPS) if self.config.presets is not False else []
        for g in groups:
            order = [x for x in order if (x if isinstance(x, str) else x.name) != g.name]
            where, _, name = g.position.partition(":")
            names = [x if isinstance(x, str) else x.name for x in order]
            if where in ("before", "after") and name in names:
                order.insert(names.index(name) + (where == "after"), g)
            elif where in ("start", "end") and not name:
                order.insert(0 if where == "start" else len(order), g)
            else:
                raise ValueError(f"no position {g.position!r}")
        self.order = tuple(order)

    def plan(self) -> Plan:
        return Plan(self.config, self.order, self.safe_tags, self.safe_blocks)

    # --- columns ---
    def column(self, c: Column, changes: bool = False) -> Column:
        """struct<typeset, code, message> of a text: one Arrow function with the whole chain. With changes, its edit ranges too."""
        import pyarrow as pa

        config, order, safe_tags, safe_blocks = self.config, self.order, self.safe_tags, self.safe_blocks
        made: list[Plan] = []

        @F.arrow_udf("typeset string, code string, message string" + (", changes array<struct<start: int, end: int>>" if changes else ""))
        def run(texts):
            if not made:
                made.append(Plan(config, order, safe_tags, safe_blocks))
            texts = texts.to_pylist()
            out, codes, messages = made[0].typeset_all(texts)
            arrays, names = [pa.array(out, pa.string()), pa.array(codes, pa.string()), pa.array(messages, pa.string())], ["typeset", "code", "message"]
            if changes:
                arrays, names = [*arrays, diff.ranges_array(texts, out)], [*names, "changes"]
            return pa.StructArray.from_arrays(arrays, names)

        return run(c)

    def transform(self, df: DataFrame, col: str = "text", out: str = "typeset", status: str | None = None) -> DataFrame:
        """Adds out: the typeset text. Null stays null. A text over the length cap, malformed or over the time budget has null in out and says why in status (struct<code, message>), or raises if the
        configuration is strict."""
        ship(df.sparkSession)
        done = self.column(F.col(col))
        error = F.when(done["code"].isNotNull(), F.struct(done["code"].alias("code"), done["message"].alias("message")))
        return df.withColumns({out: self._result(done)} | ({status: error} if status else {}))

    def _result(self, done: Column) -> Column:
        if not self.config.strict:
            return done["typeset"]
        return F.when(done["code"].isNotNull(), F.raise_error(done["message"]).cast("string")).otherwise(done["typeset"])

    def changes(self, df: DataFrame, col: str = "text", out: str = "changes") -> DataFrame:
        """One row per edit range: the columns of df, typeset, start and end in UTF-16 units of the output."""
        ship(df.sparkSession)
        done = self.column(F.col(col), True)
        both = df.withColumns({"typeset": self._result(done), out: done["changes"]})
        return both.withColumn(out, F.explode_outer(out)).select(*df.columns, "typeset", F.col(f"{out}.start").alias("start"), F.col(f"{out}.end").alias("end"))

    def rules_table(self, spark) -> DataFrame:
        """The catalogue: one row per rule."""
        rows = [(n, r.group, r.id, r.default, r.html_only, r.cycled, r.id in self.enabled) for n, r in enumerate(RULES)]
        return spark.createDataFrame(rows, "position int, group string, id string, default_enabled boolean, html_only boolean, cycled boolean, enabled boolean")


def typeset(df: DataFrame, col: str = "text", out: str = "typeset", **config) -> DataFrame:
    return Typesetter(Config(**config)).transform(df, col, out)
