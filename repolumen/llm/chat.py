"""Chat examples by prefix-target expansion: one example for every assistant turn."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
#: Characters of examples in one batch that a task hands on.
BATCH = 1 << 22


def escaped(text: str) -> str:
    """The text without ``<|``: every ``<``, backslashes, ``|`` gets one more backslash. ``unescaped`` undoes it."""
    import re

    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "<" in text else text


def unescaped(text: str) -> str:
    import re

    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def _role(role: str) -> str:
    """A role on one line."""
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_back(text: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(text))


def turn_text(role: str, text: str) -> tuple[str, str, str]:
    """What stands before the text of a turn, the text, and what stands after it."""
    return f"{START}{_role(role)}\n", escaped(text), f"{END}\n"


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of the turns of a formatted example."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((_role_back(role), unescaped(text.removesuffix(f"{END}\n"))))
    return turns


def examples(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, example, formatted, loss_start, loss_end): the training examples of all conversations.

    Turns go by number (ties by role, then text; null numbers first). Every assistant turn is an example of its own:
    all turns up to it as context, and only its text between ``loss_start`` and ``loss_end`` (code points of
    ``formatted``) is trained on. A conversation that does not end with an assistant turn has a last example with an
    empty span at its end, so that no turn is lost. Null texts and roles are empty; repeated rows are turns of their
    own; a null conversation is one like any other. Control strings in texts are escaped, see ``escaped``.

    Rows are dealt by conversation and sorted; a task holds one conversation's prefix at a time. The output grows with
    the square of a conversation's length, as every prefix is written out.
    """
    rows = turns.select(
        F.col(conversation).alias("c"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.col(turn).alias("k"))
    rows = rows.repartition("c").sortWithinPartitions("c", "k", "r", "t").select("c", "r", "t")
    schema = T.StructType([
        T.StructField(conversation, rows.schema["c"].dataType), T.StructField("example", T.IntegerType()),
        T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def run(batches):
        held, size = [], 0
        for made in _expanded(_rows(batches)):
            held.append(made)
            size += len(made[2])
            if size >= BATCH:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    columns = zip(zip(*rows, strict=True), schema.fields, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, to_arrow_type(f.dataType)) for v, f in columns], names=schema.names)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _expanded(rows) -> Iterator[tuple]:
    """(conversation, example, formatted, loss_start, loss_end) from sorted (conversation, role, text)."""
    from itertools import groupby

    for conversation, turns in groupby(rows, key=lambda r: r[0]):
        prefix, number, open_turns = "", 0, False
        for _, role, text in turns:
            before, body, after = turn_text(role, text)
            start = len(prefix) + len(before)
            prefix += before + body + after
            open_turns = role != TRAINED
            if not open_turns:
                yield conversation, number, prefix, start, start + len(body)
                number += 1
        if open_turns:
            yield conversation, number, prefix, len(prefix), len(prefix)


def read_back(made: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the examples of each conversation hold: turns and loss text, as counts and digests.

    ``made`` comes from ``examples``, whose rows stand by conversation and in order in their partitions; the digests
    are taken on the way, without another exchange.
    """
    schema = T.StructType([
        T.StructField(conversation, made.schema[conversation].dataType), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        from hashlib import sha256
        from itertools import groupby

        found = []
        for c, made in groupby(_rows(batches), key=lambda r: r[0]):
            loss, chars, total, last = sha256(), 0, 0, ""
            for _, _, formatted, start, end in made:
                text = unescaped(formatted[start:end])
                loss.update(text.encode())
                chars, total, last = chars + len(text), total + len(formatted), formatted
            turns, all_turns = parsed(last), sha256()
            for role, text in turns:
                all_turns.update(f"{role}\n{text}\n".encode())
            found.append((c, len(turns), all_turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(found) >= 4096:
                yield _batch(found, schema)
                found = []
        if found:
            yield _batch(found, schema)

    return made.mapInArrow(run, schema)
