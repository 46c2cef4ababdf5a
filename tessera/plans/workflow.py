"""Workflows: tasks and flows in JSON, run as one lazy graph of DataFrames."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.registry import OPERATORS, ParameterError, run


class WorkflowError(ValueError):
    """A graph that has a cycle, an unknown task or a missing input."""


@dataclass
class Task:
    id: str
    slug: str
    params: dict = field(default_factory=dict)
    enabled: bool = True
    order: int = 0


@dataclass
class Flow:
    source: str
    target: str
    source_port: str = "output data"
    target_port: str = "input data"


@dataclass
class Workflow:
    tasks: dict[str, Task]
    flows: list[Flow]
    variables: dict = field(default_factory=dict)

    @staticmethod
    def parse(spec: dict) -> Workflow:
        """From JSON; a form's value may be {'value': v} or v, and ${name} stands for a variable's value."""
        variables = {v["name"]: v.get("value", v.get("default_value")) for v in spec.get("variables") or []}
        tasks = {}
        for t in spec["tasks"]:
            forms = t.get("forms") or {}
            params = {k: substitute(v["value"] if isinstance(v, dict) and "value" in v else v, variables) for k, v in forms.items()}
            tasks[str(t["id"])] = Task(str(t["id"]), t["operation"]["slug"], params, t.get("enabled", True), t.get("display_order", 0))
        flows = [Flow(str(f["source_id"]), str(f["target_id"]), f.get("source_port_name") or "output data", f.get("target_port_name") or "input data") for f in spec.get("flows") or []]
        return Workflow(tasks, flows, variables)

    def order(self) -> list[Task]:
        """Tasks so that each comes after those it reads from."""
        for f in self.flows:
            if f.source not in self.tasks or f.target not in self.tasks:
                raise WorkflowError(f"flow {f.source} -> {f.target} names an unknown task")
        waiting = {i: {f.source for f in self.flows if f.target == i and self.tasks[f.source].enabled} for i, t in self.tasks.items() if t.enabled}
        done: list[Task] = []
        while waiting:
            ready = sorted((i for i, w in waiting.items() if not w), key=lambda i: (self.tasks[i].order, i))
            if not ready:
                raise WorkflowError("the workflow has a cycle")
            for i in ready:
                done.append(self.tasks[i])
                del waiting[i]
            for w in waiting.values():
                w.difference_update(ready)
        return done

    def execute(self, spark: SparkSession, sources: dict[str, DataFrame] | None = None, wanted: list[str] | None = None) -> dict[str, dict]:
        """Outputs by task. Nothing runs until an output is acted on, except operators that need a look at the data. With
        ``wanted``, only those tasks and what they read from are built. A frame with several readers is one plan node in each."""
        needed = set(wanted or self.tasks)
        for t in reversed(self.order()):
            if t.id in needed:
                needed |= {f.source for f in self.flows if f.target == t.id}
        results: dict[str, dict] = {}
        for task in self.order():
            if task.id not in needed:
                continue
            inputs: dict = {}
            for f in self.flows:
                if f.target == task.id and f.source in results:
                    outputs = results[f.source]
                    if f.source_port not in outputs:
                        raise WorkflowError(f"task {f.source} has no output {f.source_port}")
                    inputs[f.target_port] = outputs[f.source_port]
            if sources and task.id in sources:
                results[task.id] = {"output data": sources[task.id]}
                continue
            if task.slug not in OPERATORS:
                from tessera.operators.registry import _load

                _load()
            params = dict(task.params)
            if task.slug in ("data-reader", "data-source", "read-data", "read-csv", "read-shapefile", "read-files"):
                params["spark"] = spark
            try:
                results[task.id] = run(task.slug, inputs, **params)
            except KeyError as e:
                raise WorkflowError(f"task {task.id} ({task.slug}) lacks {e}") from e
            except ParameterError as e:
                raise ParameterError(f"task {task.id} ({task.slug}): {e}") from e
        return results


def substitute(value, variables: dict):
    """Variables in texts, lists and dicts."""
    if isinstance(value, str):
        whole = re.fullmatch(r"\$\{(\w+)\}", value)
        if whole and whole[1] in variables:
            return variables[whole[1]]
        return re.sub(r"\$\{(\w+)\}", lambda m: str(variables.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: substitute(v, variables) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, variables) for v in value]
    return value


def run_workflow(spark: SparkSession, spec: dict, **options) -> dict[str, dict]:
    return Workflow.parse(spec).execute(spark, **options)
