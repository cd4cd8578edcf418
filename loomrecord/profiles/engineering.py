"""Trajectories of software-engineering agents as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.profiles.base import Profile, derived, located_path, taken

# Names under which each part of a record is written, in the order in which they are tried.
TASK_IDS = ["task_id", "taskId", "instance_id", "instanceId", "issue_id", "issueId", "trajectory_id", "trajectoryId", "run_id", "runId"]
TASK_TEXTS = ["task", "problem_statement", "problemStatement", "issue"]
STEPS = ["step_id", "stepId", "step", "step_index", "stepIndex"]
PARENT_STEPS = ["parent_step_id", "parentStepId", "parent_step", "parentStep"]
CALL_IDS = ["tool_call_id", "toolCallId", "call_id", "callId", "action_id", "actionId"]
WORKFLOW = ["action", "command", "observation", "tool", "tool_name", "toolName", "patch", "diff", "test", "tests", "test_result", "testResult", "result", "outcome"]
DISTINCTIVE = ["patch", "diff", "observation", "test_result", "testResult", "problem_statement"]
TOOLS = ["tool", "tool_name", "toolName"]
ACTIONS = ["action", "command", "thought"]
OBSERVATIONS = ["observation", "tool_output", "toolOutput"]
PATCHES = ["patch", "diff"]
TESTS = ["test_result", "testResult", "tests", "test"]
OUTCOMES = ["outcome", "result", "status"]
TYPES = ["event", "event_type", "type", "kind"]
TIMES = ["timestamp", "time", "created_at", "createdAt"]
# Keys whose value stands for an object, words of failure, and labels of kinds.
TELLING = ["command", "query", "message", "output", "result", "status", "summary"]
FAILURE = r"(?i)(?<![A-Za-z0-9_])(fail(?:ed|ure)?|error|timeout|cancelled|canceled)(?![A-Za-z0-9_])"
LABELS = {"action": "Action", "observation": "Observation", "patch": "Patch", "test": "Test", "result": "Result", "error": "Failed", "task": "Task", "turn": "Step"}
ACTORS = {"observation": "tool", "test": "tool", "result": "tool", "error": "tool", "action": "agent", "turn": "agent", "patch": "agent"}


# The fields that are read of a record, each once, in one pass over it.
KEYS = list(dict.fromkeys([*TASK_TEXTS, *TASK_IDS, *STEPS, *PARENT_STEPS, *CALL_IDS, *WORKFLOW, *DISTINCTIVE, *TOOLS, *ACTIONS, *OBSERVATIONS, *PATCHES, *TESTS, *OUTCOMES, *TYPES, *TIMES]))


def _any(keys: list[str]) -> Column:
    """Whether any of the keys is there, JSON null included."""
    return F.expr(" OR ".join(f"_f.`{k}` IS NOT NULL" for k in keys))


def _found(keys: list[str]) -> Column:
    """The first of the keys that is there and not null."""
    return taken(lambda k: "_f", *[(k,) for k in keys])


def _short(value: Column) -> Column:
    """One line for a value; an object shows its first telling key."""
    return F.when(value.isNotNull(), J.bounded_summary(J.let_sql(value, "coalesce(" + ", ".join(J.get_sql("v", k) for k in TELLING) + ", v)")))


def _failed(value: Column) -> Column:
    inner = F.coalesce(*[J.let_sql(value, J.scalar_sql(J.get_sql("v", k))) for k in ("status", "outcome", "result")])
    return F.coalesce(F.coalesce(F.when(J.is_object(value), inner), J.bounded_summary(value)).rlike(FAILURE) & value.isNotNull(), F.lit(False))


def _screen(records: DataFrame) -> DataFrame:
    df = J.fence(records, _f=J.fields(F.col("value"), *KEYS))
    return J.fence(df, _step=_found(STEPS), _steps=F.expr("size(try_variant_get(value, '$.trajectory', 'array<variant>'))"))


def _prepare(records: DataFrame) -> DataFrame:
    df = _screen(records)
    parts = {"_task": [*TASK_TEXTS, *TASK_IDS], "_task_id": TASK_IDS, "_parent": PARENT_STEPS, "_call": CALL_IDS, "_action": ACTIONS, "_observed": OBSERVATIONS, "_patch": PATCHES,
             "_test": TESTS, "_outcome": OUTCOMES, "_discriminator": TYPES, "_time": TIMES}
    tool = F.coalesce(_found(TOOLS), F.expr(J.get_sql("value", "action", "tool")), F.expr(J.get_sql("value", "action", "name")))
    df = J.fence(df, **{n: _found(keys) for n, keys in parts.items()}, _tool=tool)
    kind = F.lower(J.scalar_text(F.col("_discriminator")))
    def typed(*names: str) -> Column:
        return F.coalesce(kind.isin(list(names)), F.lit(False))
    found = F.when(F.col("_f").isNull(), "other").when(F.col("_steps") >= 0, "task").when(typed("error", "failed", "failure") | _failed(F.col("_outcome")) | _failed(F.col("_test")), "error").when(
        F.col("_observed").isNotNull(), "observation").when(F.col("_action").isNotNull() | F.col("_tool").isNotNull() | typed("action", "tool", "tool_call", "tool_use"), "action").when(
        F.col("_patch").isNotNull() | typed("patch", "diff", "checkpoint"), "patch").when(F.col("_test").isNotNull() | typed("test"), "test").when(
        F.col("_outcome").isNotNull() | typed("result", "outcome"), "result").when(F.col("_task").isNotNull() & F.col("_step").isNull(), "task").when(F.col("_step").isNotNull(), "turn").otherwise("other")
    return J.fence(df, _kind=found)


def _columns() -> dict[str, Column]:
    kind, steps = F.col("_kind"), F.col("_steps")
    shown = F.coalesce("_observed", "_outcome", "_action", "_patch", "_test", "_task", "_discriminator")
    label = F.when((kind == "action") & F.col("_tool").isNotNull(), F.concat(F.lit("Tool "), _short(F.col("_tool")))).otherwise(F.coalesce(J.lookup(LABELS, kind), F.lit("Agent record")))
    held = F.concat(F.lit("Trajectory container: "), steps.cast("string"), F.when(steps == 1, " step").otherwise(" steps"))
    step, container = J.scalar_text(F.col("_step")), (steps >= 0) & F.col("_f").isNotNull()
    texts = {"task": "_task", "tool": "_tool", "action": "_action", "observation": "_observed", "patch": "_patch", "test": "_test", "outcome": "_outcome"}
    return {
        "event_kind": kind, "timestamp_raw": J.scalar_text(F.col("_time")), "actor": F.when(F.col("_f").isNotNull(), F.coalesce(J.lookup(ACTORS, kind), F.lit("system"))),
        "session_id": J.scalar_text(F.col("_task_id")), "turn_id": step, "message_id": F.when(~kind.isin("observation", "result", "test"), step), "parent_id": J.scalar_text(F.col("_parent")),
        "tool_call_id": F.coalesce(J.scalar_text(F.col("_call")), F.when(kind.isin("action", "observation"), step)), "status": _short(F.col("_outcome")), "severity": F.when(kind == "error", "error"),
        "summary": F.when(container, held).when(F.col("_f").isNull(), J.bounded_summary(F.col("value"))).otherwise(J.bounded_summary(F.coalesce(shown, F.col("value")), label)),
        "confidence": F.when(F.col("_discriminator").isNotNull() | shown.isNotNull(), "source").otherwise("inferred"),
        "derived": derived(**{n: _short(F.col(c)).cast("variant") for n, c in texts.items()}, taskId=J.scalar_text(F.col("_task_id")).cast("variant"), step=F.coalesce(step, _short(F.col("_step"))).cast("variant"),
                           parentStep=J.scalar_text(F.col("_parent")).cast("variant"), containerKind=F.when(container, "trajectory").cast("variant"), stepCount=F.when(container, steps).cast("variant")),
    }


def _signals() -> dict[str, Column]:
    held, task, step = F.col("_steps") >= 0, _found([*TASK_IDS, *TASK_TEXTS]).isNotNull(), F.col("_step").isNotNull()
    return {"containers": F.coalesce(held, F.lit(False)), "workflow": F.coalesce(_any(WORKFLOW) & (task | step), F.lit(False)), "tasks": task, "steps": step, "marked": F.coalesce(_any(DISTINCTIVE), F.lit(False))}


def _score(s, n):
    two, marks = F.least(F.lit(2), n), s["containers"] + s["marked"]
    whole = (s["containers"] > 0) & (s["tasks"] > 0)
    single = (s["workflow"] >= two) & ((s["tasks"] > 0) | (s["steps"] >= two)) & (marks > 0)
    def part(c: Column, of) -> Column:
        return F.least(F.lit(1.0), c / of)
    rows = 0.44 * part(s["workflow"], two) + 0.22 * part(s["tasks"], two) + 0.16 * part(s["steps"], two) + 0.13 * part(marks, F.lit(2))
    return F.when(whole, F.least(F.lit(0.98), 0.88 + 0.1 * part(s["containers"], n))).otherwise(F.least(F.lit(0.95), rows)), whole | single


def _evidence() -> dict[str, Column]:
    def at(keys: list[str]) -> Column:
        return located_path("value", *[(k,) for k in keys])
    shown = F.coalesce(*[at(k) for k in (OBSERVATIONS, OUTCOMES, ACTIONS, PATCHES, TESTS, [*TASK_TEXTS, *TASK_IDS], TYPES)])
    step_call = F.when(F.col("_kind").isin("action", "observation"), at(STEPS))
    return {"event_kind": F.coalesce(at(TYPES), shown), "timestamp_raw": at(TIMES), "session_id": at(TASK_IDS), "turn_id": at(STEPS), "message_id": at(STEPS), "parent_id": at(PARENT_STEPS),
            "tool_call_id": F.when(J.scalar_text(F.col("_call")).isNotNull(), at(CALL_IDS)).otherwise(step_call), "status": at(OUTCOMES), "summary": F.when(F.col("_steps") >= 0, "$.trajectory").otherwise(shown)}


ENGINEERING = Profile("software-engineering-agent", "1", _columns, _signals, _score, _prepare, _evidence, screen=_screen)
