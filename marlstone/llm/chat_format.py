r"""Chat formatting with a grammar round trip.

Grammar of a rendered conversation, turn after turn::

    turn    := "### " role ": " content "\n</turn>\n"
    control := "###" blanks* letters ":"  |  "</turn>"

A control string with no backslash before it belongs to the template. A text's own control string is escaped with one
more backslash than stands before it, and the parser takes one away, so any text can be told apart and got back: a
backslash run that no control string follows is left alone. The parser is deterministic and reads left to right.

A turn is rendered with its raw content first and parsed again. Where the parser does not return the source turn (the
content has a control string, or an escaped one, of its own), the conflicting control strings are escaped, and the turn is
rendered and parsed again until both are identical; one pass suffices for this grammar, more than ``max_passes`` raise.
Roles are written with their first letter in upper case when that can be undone, and percent-escaped otherwise.

Turns are rendered where they lie, each by itself. Reading back needs the turns of a conversation in order, since its
digests run over all of them: the rendered turns are sorted by Spark (which spills) and streamed, as the one text that they are
together, through one parser and one incremental hash for each conversation. What the loss covers is cut out of that text by its
spans. No conversation is ever held in memory.

Defined results: a null text or role is the empty string; turns are ordered by turn (null first), then role, then text, and
repeated rows are turns of their own; rows with a null conv_id form one conversation; other columns are ignored; an empty
table gives an empty table. A very long turn is rendered whole, alone in its batch if need be; a conversation is read back as a stream, so
no more of it is held than one turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_CONTROL = r"###[ \t]*[^\W\d_]+:|</turn>"
_ANY = re.compile(rf"(\\*)({_CONTROL})")
_HEAD = re.compile(r"### ([^\s:]*): ")
_END = "\n</turn>\n"
_PLAIN_ROLE = re.compile(r"[a-z][a-z]*\Z")
TURNS = "conv_id bigint, turn bigint, role string, text string, rendered string, loss_start int, loss_end int, passes int"


class ParseError(ValueError):
    pass


def write_role(role: str) -> str:
    if _PLAIN_ROLE.match(role):
        return role[0].upper() + role[1:]
    return "%" + "".join(f"{b:02x}" for b in role.encode("utf-8", "surrogatepass"))


def read_role(word: str) -> str:
    if word[:1] == "%":
        return bytes.fromhex(word[1:]).decode("utf-8", "surrogatepass")
    return word[:1].lower() + word[1:]


def escape(text: str) -> str:
    return _ANY.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ANY.sub(lambda m: m[1][1:] + m[2], text)


def render(role: str, content: str) -> tuple[str, int, int]:
    """A rendered turn and where its content lies in it."""
    head = f"### {write_role(role)}: "
    return head + content + _END, len(head), len(head) + len(content)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, start and end of the content of each turn."""
    at = 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            raise ParseError(f"no turn starts at {at}")
        start = head.end()
        end = rendered.find(_END, start)
        if end < 0:
            raise ParseError("a turn does not end")
        content = rendered[start:end]
        if any(not m[1] for m in _ANY.finditer(content)):
            raise ParseError("a control string stands inside a turn")
        yield read_role(head[1]), unescape(content), start, end
        at = end + len(_END)


class Reader:
    """The turns of one conversation that comes in parts, cut anywhere; it holds no more than the turn that is not ended yet."""

    def __init__(self):
        self.held = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        """role and text of the turns that end in this part."""
        self.held += part
        # A turn's end may be cut, and what follows it starts the next turn.
        end = self.held.rfind(_END)
        if end >= 0:
            whole, self.held = self.held[: end + len(_END)], self.held[end + len(_END) :]
            yield from (x[:2] for x in parse(whole))

    def close(self) -> None:
        if self.held:
            raise ParseError("a turn does not end")


def format_turn(role: str, text: str, max_passes: int = 3) -> tuple[str, int, int, int]:
    """Rendered turn, span of its content, and how many passes of escaping it took to get the source back."""
    content = text
    for passes in range(max_passes + 1):
        rendered, start, end = render(role, content)
        try:
            if [x[:2] for x in parse(rendered)] == [(role, text)]:
                return rendered, start, end, passes
        except ParseError:
            pass
        content = escape(content)
    raise ParseError("the turn can't be told apart from its template")


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each turn with its rendered text and, for ``loss_role``, the span in it that the loss covers (else both null)."""

    def run(batches):
        for b in batches:
            out = {"rendered": [], "loss_start": [], "loss_end": [], "passes": []}
            for role, text in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                rendered, start, end, passes = format_turn(role, text)
                own = role == loss_role
                for k, v in zip(out, (rendered, start if own else None, end if own else None, passes), strict=True):
                    out[k].append(v)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=[*b.schema.names, *out])

    blank = F.lit("")
    own = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    return map_arrow(own, run, TURNS)


def read_back(rendered: DataFrame) -> DataFrame:
    """What the rendered turns say, per conversation: the number and digest of turns, and the loss text's length and digest.

    ``rendered`` has conv_id, turn, rendered, loss_start and loss_end, and the columns role and text only order its rows. Turns come from
    a parse of the conversation as a whole, the loss text from its spans alone.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches):
        key, state, done = None, None, []

        def flush():
            out = pa.RecordBatch.from_pylist(done, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
            done.clear()
            return out

        def close():
            n, all_turns, n_loss, loss, chars, reader = state
            reader.close()
            done.append({"conv_id": key, "n_turns": n, "turns_sha256": all_turns.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})

        for b in batches:
            for conv, text, start, end in zip(*(b[c].to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                for role, said in state[5].feed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    said = unescape(text[start:end])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(done) >= 5000:
                yield flush()
        if state is not None:
            close()
        if done:
            yield flush()

    dealt = rendered.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(dealt.select("conv_id", "rendered", "loss_start", "loss_end"), run, schema)
