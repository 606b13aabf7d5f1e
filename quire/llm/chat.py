"""Chat formatting: a compiled template renders whole conversations and marks what a model is trained on.

Defined results: a null text or role is the empty string; turns are ordered by turn (nulls first), then role, then
text, so ties and repeated rows have one order and each is kept; a null conv_id is a conversation of its own; an empty
table gives no conversation; control strings inside texts are escaped reversibly, and so are line ends inside roles.
Other columns of the input are ignored. A conversation becomes one row, so its turns do meet in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .template import Template

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role | role }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | guard }}{% endgeneration %}{% else %}{{ m.text | guard }}{% endif %}"
    + END + "\n{% endfor %}{% if add_generation_prompt %}" + START + "assistant\n{% endif %}"
)
_OPEN, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def guard(text: str) -> str:
    r"""text with no <| in it: each <\...\| gets one more backslash."""
    return _OPEN.sub(r"<\1\\|", text)


def unguard(text: str) -> str:
    return _GUARDED.sub(r"<\1|", text)


def guard_role(role: str) -> str:
    return guard(role.replace("&", "&a").replace("\n", "&n"))


def unguard_role(role: str) -> str:
    return re.sub("&([an])", lambda m: "&" if m[1] == "a" else "\n", unguard(role))


def compiled(template: str = TEMPLATE) -> Template:
    return Template(template, {"guard": lambda x: guard(x or ""), "role": lambda x: guard_role(x or "")})


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unguard_role(r), unguard(t)) for r, t in _TURN.findall(text)]


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id_col and messages, an array of struct(turn, role, text) in order."""
    message = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(message)).alias("messages"))


def format_chats(rows: DataFrame, template: str = TEMPLATE, add_generation_prompt: bool = False, id_col: str = "conv_id", **cols: str) -> DataFrame:
    """One row per conversation: id_col, formatted (string), loss_spans (array of [start, end) in code points)."""

    def run(messages: pd.Series) -> pd.DataFrame:
        t = compiled(template)
        made = [t.render(messages=[{"role": m["role"], "text": m["text"]} for m in ms], add_generation_prompt=add_generation_prompt) for ms in messages]
        return pd.DataFrame({"formatted": [x for x, _ in made], "loss_spans": [[list(s) for s in spans] for _, spans in made]})

    render: Column = F.pandas_udf(run, "formatted string, loss_spans array<array<long>>")(F.col("messages"))
    made = conversations(rows, id_col=id_col, **cols).select(id_col, render.alias("chat"))
    return made.select(id_col, "chat.formatted", "chat.loss_spans")


def digest_rows(chats: DataFrame) -> DataFrame:
    """The contract's columns, all read back from the formatted text and its loss spans."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for conv, text, spans in zip(b["conv_id"], b["formatted"], b["loss_spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unguard(text[s[0] : s[1]]) for s in spans)
                sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return chats.select("conv_id", "formatted", "loss_spans").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
