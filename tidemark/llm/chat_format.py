"""Chat formatting by a declarative template, with DataFrame functions alone.

A template names the strings that mark turns, the roles whose texts are trained on
and the turn orders that are allowed: a finite-state machine whose states are the
roles. Formatting emits text segments, each with a loss flag; joined, they are the
formatted conversation. Control strings inside texts are broken up by an escape
character, which reading back removes again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """begin, then for each turn open, role, mid, text, close; see CHAT."""

    begin: str
    open: str
    mid: str
    close: str
    escape: str
    loss_roles: tuple[str, ...]
    #: state -> roles that may follow; a state is the role before, or "" at the start.
    follows: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Accepting states: the roles that a conversation may end on.
    ends: tuple[str, ...] = ()

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.open, self.mid, self.close)


CHAT = Template(
    begin="<s>",
    open="[INST]",
    mid="[/INST]",
    close="</s>",
    escape="\x1b",
    loss_roles=("assistant",),
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)


def escaped(text: Column, template: Template) -> Column:
    """Doubles the escape character and sets one after the first character of each control string."""
    e = template.escape
    text = F.replace(text, F.lit(e), F.lit(e + e))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(c[0] + e + c[1:]))
    return text


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"{template.escape}({template.escape}?)", "$1")


def _first_error(roles: Column, template: Template) -> Column:
    """The machine over the roles: the first turn, from 0, that may not follow its predecessor; the number of turns if only an end is missing; -1 if none."""
    allowed = F.create_map(*[x for state, to in template.follows.items() for x in (F.lit(state), F.array(*map(F.lit, to)))])
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("error"))

    def step(s: Column, role: Column) -> Column:
        fits = F.coalesce(F.array_contains(F.element_at(allowed, s["state"]), role), F.lit(False))
        return F.struct(
            role.alias("state"),
            (s["at"] + 1).alias("at"),
            F.when((s["error"] < 0) & ~fits, s["at"]).otherwise(s["error"]).alias("error"),
        )

    ended = lambda s: F.coalesce(s["state"].isin(*template.ends), F.lit(False))
    return F.aggregate(roles, start, step, lambda s: F.when((s["error"] < 0) & ~ended(s), s["at"]).otherwise(s["error"]))


def format_conversations(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row for each conv_id: conv_id, segments, formatted, valid, error_turn.

    Turns are ordered by turn, nulls first, ties by role and text; a null role or
    text counts as empty. Every conversation is formatted, valid or not: `valid`
    says whether the machine accepts its order of roles and stops in an accepting
    state, error_turn names the first turn, from 0, that it does not accept, or, if
    only an end is missing, the turn after the last (else null). Rows with a null conv_id make
    one conversation. Repeated rows are repeated turns. Empty tables give no rows.
    Other columns are ignored, so their names cannot clash. A conversation is one
    row of output, so its turns meet in one task, those of others do not.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    off = F.lit(False)
    each = F.transform(
        F.col("turns"),
        lambda t: F.array(
            segment(F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.mid)), off),
            segment(escaped(t["text"], template), t["role"].isin(*template.loss_roles)),
            segment(F.lit(template.close), off),
        ),
    )
    segments = F.concat(F.array(segment(F.lit(template.begin), off)), F.flatten(each))
    error = _first_error(F.transform("turns", lambda t: t["role"]), template)
    made = grouped.select("conv_id", segments.alias("segments"), error.alias("error"))
    return made.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("error") < 0).alias("valid"),
        F.when(F.col("error") >= 0, F.col("error")).alias("error_turn"),
    )


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """The turns, as an array of (role, text), from a formatted conversation alone."""
    inner = F.substring(formatted, len(template.begin) + 1, 2**31 - 1)
    quoted = lambda s: "\\Q" + s + "\\E"
    pieces = F.split(inner, quoted(template.close))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    pattern = f"(?s)^{quoted(template.open)}(.*?){quoted(template.mid)}(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, pattern, 1), template).alias("role"),
            unescaped(F.regexp_extract(p, pattern, 2), template).alias("text"),
        ),
    )


QUERY = "op5_chat_format"

_EXTRA = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_EXTRA}'), (-7L, 1L, 'assistant', '{_EXTRA}') AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = format_conversations(turns).withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], CHAT)), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.coalesce(F.col("error_turn").cast("long"), F.lit(-1)).alias("error_turn"),
    )


def _sql_escaped(x: str) -> str:
    x = f"replace({x}, chr(27), chr(27) || chr(27))"
    for c in CHAT.controls:
        x = f"replace({x}, '{c}', '{c[0]}' || chr(27) || '{c[1:]}')"
    return x


_FITS = " OR ".join(f"(before = '{state}' AND role IN ({', '.join(repr(x) for x in to)}))" for state, to in CHAT.follows.items())

_ENDS = ", ".join(map(repr, CHAT.ends))

ORACLE_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_EXTRA}'
  UNION ALL SELECT -7, 1, 'assistant', '{_EXTRA}'
),
ordered AS (SELECT *, row_number() OVER w - 1 AS nth, coalesce(lag(role) OVER w, '') AS before FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
checked AS (SELECT *, {_FITS} AS fits FROM ordered)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) AS BIGINT) AS formatted_chars,
       bool_and(fits) AND max_by(role, nth) IN ({_ENDS}) AS valid,
       coalesce(min(nth) FILTER (WHERE NOT fits), CASE WHEN max_by(role, nth) IN ({_ENDS}) THEN -1 ELSE count(*) END) AS error_turn
FROM checked GROUP BY conv_id
"""
