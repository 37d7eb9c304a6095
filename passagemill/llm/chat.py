"""Chat formatting with typed content parts, by DataFrame functions alone.

A turn's content is an array of parts (``PARTS``): text, image, audio or document. A visitor turns
each part into a piece of the formatted text. Text is escaped; any other part becomes a
placeholder, and its reference and the number of tokens it expands to are recorded: the i-th
placeholder of a conversation belongs to the i-th attachment.

The formatted text of a conversation is ``<s>`` and, for each turn, ``[ROLE]`` role ``[/ROLE]``
content ``</s>``. A control string that stands in a text or role gets one more backslash after its
first character, so that no text can pose as a mark, and ``read_back`` takes exactly one away: any
text comes back as it was, whatever it holds.

``format_chats`` gives one row per conversation. The loss mask is a list of spans in code points,
one for each text part of an assistant's turn. Starts are running sums over sorted rows, and spans
are cut from fixed-width code points, so the work is linear in a conversation's length.

Nulls: a null text, role or part counts as empty, null content as no parts; rows without
``conv_id`` are one conversation. A part of another type, or without one, is a file of unknown
size. Very long texts: each is escaped in its own row before rows meet; a conversation is one value
of the result and must fit one (2 GB). Ties: equal turn numbers follow role, then content; repeated
rows are turns of their own. An empty table gives no rows. Columns beside the four that are named
are left out of the result, and may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = (
    "array<struct<type: string, text: string, ref: string, width: int, height: int, "
    "seconds: double, pages: int>>"
)


@dataclass(frozen=True)
class Template:
    """Marks of the format, and ``foreign`` ones that texts may not carry raw either."""

    begin: str = "<s>"
    role: str = "[ROLE]"
    content: str = "[/ROLE]"
    end: str = "</s>"
    image: str = "[IMAGE]"
    audio: str = "[AUDIO]"
    document: str = "[DOCUMENT]"
    file: str = "[FILE]"
    foreign: tuple[str, ...] = ("[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
    learned: tuple[str, ...] = ("assistant",)

    @property
    def placeholders(self) -> tuple[str, ...]:
        return self.image, self.audio, self.document, self.file

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.role, self.content, self.end, *self.placeholders, *self.foreign)

    def _pattern(self, slashes: str) -> str:
        heads = "".join(sorted({re.escape(m[0]) for m in self.marks}))
        tails = "|".join(re.escape(m[1:]) for m in self.marks)
        return rf"([{heads}]){slashes}(?=(?:{tails}))"

    def escape(self, text: Column) -> Column:
        # Most texts hold no first character of a mark, and none need a pattern then.
        some = F.lit(False)
        for head in sorted({m[0] for m in self.marks}):
            some = some | F.contains(text, F.lit(head))
        return F.when(some, F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1$2\\")).otherwise(text)

    def unescape(self, text: Column) -> Column:
        undone = F.regexp_replace(text, self._pattern(r"\\(\\*)"), "$1$2")
        return F.when(F.contains(text, F.lit("\\")), undone).otherwise(text)


@dataclass(frozen=True)
class PartVisitor:
    """What becomes of each kind of part. Every method gives the piece and the tokens it stands for."""

    template: Template = Template()
    #: Pixels along a side of an image token, audio tokens a second, tokens a document's page.
    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 576

    def text(self, part: Column) -> tuple[Column, Column]:
        return self.template.escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column) -> tuple[Column, Column]:
        tiles = F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch)
        return F.lit(self.template.image), tiles

    def audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.audio), F.ceil(part["seconds"] * self.audio_rate)

    def document(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.document), part["pages"] * self.page_tokens

    def file(self, part: Column) -> tuple[Column, Column]:
        return F.lit(self.template.file), F.lit(None)

    def visit(self, part: Column) -> Column:
        """``(kind, piece, ref, n_tokens)`` of a part."""
        named = {k: getattr(self, k) for k in ("text", "image", "audio", "document")}

        def flat(kind, method):
            piece, tokens = method(part)
            return F.struct(
                F.lit(kind).alias("kind"), piece.alias("piece"), part["ref"].alias("ref"),
                tokens.cast("long").alias("n_tokens"),
            )

        # A part that is null altogether is an empty text.
        chosen = F.when(part.isNull(), flat("text", self.text))
        for kind, method in named.items():
            chosen = chosen.when(part["type"] == kind, flat(kind, method))
        return chosen.otherwise(flat("file", self.file))


def text_part(text: Column) -> Column:
    """Plain text as content of one part."""
    empty = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("type"), text.alias("text"), empty("string").alias("ref"),
        empty("int").alias("width"), empty("int").alias("height"), empty("double").alias("seconds"),
        empty("int").alias("pages"),
    ))


def format_chats(turns: DataFrame, visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss, attachments)`` of ``(conv_id, turn, role, content)``.

    ``loss`` holds ``(start, end)`` in code points, ``attachments`` holds ``(turn, kind, ref,
    n_tokens, start)``: where the placeholder stands and how many tokens take its place.
    """
    t = visitor.template
    role = F.coalesce("role", F.lit(""))
    learned = role.isin(*t.learned)

    def segment(kind, piece, ref=None, n_tokens=None, loss=None):
        return F.struct(
            kind.alias("kind"), piece.alias("piece"),
            (F.lit(None) if ref is None else ref).cast("string").alias("ref"),
            (F.lit(None) if n_tokens is None else n_tokens).cast("long").alias("n_tokens"),
            (F.lit(False) if loss is None else loss).alias("loss"),
        )

    pieces = F.transform(F.coalesce(F.col("content").cast(PARTS), F.array().cast(PARTS)), visitor.visit)
    content = F.transform(
        pieces,
        lambda p: segment(p["kind"], p["piece"], p["ref"], p["n_tokens"], learned & (p["kind"] == "text")),
    )
    head = F.concat(F.lit(t.role), t.escape(role), F.lit(t.content))
    segments = F.concat(
        F.array(segment(F.lit("mark"), head)), content, F.array(segment(F.lit("mark"), F.lit(t.end)))
    )
    # Marks and escapes are made before rows meet, and everything after stays with conv_id.
    made = turns.select("conv_id", "turn", role.alias("role"), segments.alias("segments"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "segments")
    numbered = made.withColumn("number", F.row_number().over(order))
    spread = numbered.select("conv_id", "turn", "number", F.posexplode("segments").alias("place", "s"))
    before = (
        Window.partitionBy("conv_id").orderBy("number", "place")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    start = F.coalesce(F.sum(F.length("s.piece").cast("long")).over(before), F.lit(0)) + len(t.begin)
    placed = spread.select("conv_id", "turn", "number", "place", "s", start.alias("start"))
    whole = placed.groupBy("conv_id").agg(
        F.max("number").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("number", "place", "start", "turn", "s"))).alias("all"),
    )
    span = lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["s"]["piece"])).alias("end"))
    attached = lambda x: F.struct(
        x["turn"].alias("turn"), x["s"]["kind"].alias("kind"), x["s"]["ref"].alias("ref"),
        x["s"]["n_tokens"].alias("n_tokens"), x["start"].alias("start"),
    )
    return whole.select(
        "conv_id", "n_turns",
        F.concat(F.lit(t.begin), F.array_join(F.transform("all", lambda x: x["s"]["piece"]), "")).alias("formatted"),
        F.transform(F.filter("all", lambda x: x["s"]["loss"]), span).alias("loss"),
        F.transform(F.filter("all", lambda x: ~x["s"]["kind"].isin("mark", "text")), attached).alias("attachments"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns ``(role, texts, placeholders)`` of a formatted text, unescaped.

    ``texts`` are the stretches around the placeholders, one more than these.
    """
    t = template
    any_placeholder = "|".join(re.escape(p) for p in t.placeholders)
    inside = F.substr(formatted, F.lit(len(t.begin) + 1))
    turns = F.split(inside, re.escape(t.end))

    def turn(piece):
        two = F.split(piece, re.escape(t.content), 2)
        return F.transform(F.array(two), lambda pair: F.struct(
            t.unescape(F.substr(pair[0], F.lit(len(t.role) + 1))).alias("role"),
            F.transform(F.split(pair[1], any_placeholder), t.unescape).alias("texts"),
            F.regexp_extract_all(pair[1], F.lit(f"({any_placeholder})")).alias("placeholders"),
        ))[0]

    # The last mark ends the text, so the last piece is empty.
    return F.transform(F.filter(turns, lambda x: x != ""), turn)


def under_mask(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The texts under the spans, unescaped, in order.

    Code points are laid out four bytes each, once, so a cut costs its own length only.
    """
    both = F.array(F.struct(F.encode(formatted, "UTF-32").alias("wide"), spans.alias("spans")))

    def cuts(x):
        cut = lambda s: F.substring(
            x["wide"], (4 * s["start"] + 1).cast("int"), (4 * (s["end"] - s["start"])).cast("int")
        )
        return F.transform(x["spans"], lambda s: template.unescape(F.decode(cut(s), "UTF-32")))

    return F.flatten(F.transform(both, cuts))
