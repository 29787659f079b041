"""Publishing a run: pages, GraphML, the manifest, and the promotion of `latest`.

Tables are computed by Spark; what is written to a local folder streams through the driver row by row.
"""

from __future__ import annotations

import json
import re
import shutil
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.publish import branch_of, diagnostics_by_code, numbered_edges, numbered_nodes
from ..schema import TRIPLES

# The GraphML namespace and the three declared keys.
NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
KEYS = (("d0", "node", "kind"), ("d1", "node", "label"), ("d2", "edge", "predicate"))


_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


@dataclass
class Published:
    run_id: str
    succeeded: bool
    pages: int = 0
    nodes: int = 0
    edges: int = 0
    promoted: bool = False
    reason: str = ""
    exit_code: int = 0
    diagnostics: dict[str, int] = field(default_factory=dict)


def run_id(now: datetime) -> str:
    return now.astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S%f")[:-3] + "Z"


def _text(value: str) -> str:
    """Escaped text; characters that XML can't hold become U+FFFD."""
    return escape(_NOT_XML.sub("\ufffd", value))


def write_graphml(triples: DataFrame, target: Path) -> tuple[int, int]:
    """The graph as GraphML; returns the numbers of nodes and edges. Node ids are found by a join, not a dictionary."""
    nodes = numbered_nodes(triples)
    ids = nodes.select("key", "node_id")
    edges = numbered_edges(triples).join(ids.withColumnsRenamed({"key": "source", "node_id": "s"}), "source").join(ids.withColumnsRenamed({"key": "target", "node_id": "t"}), "target")
    counts = [0, 0]
    with target.open("w", encoding="utf-8") as f:
        f.write(f"<graphml xmlns={quoteattr(NAMESPACE)}>")
        f.writelines(f'<key id="{k}" for="{on}" attr.name="{name}" attr.type="string" />' for k, on, name in KEYS)
        f.write('<graph edgedefault="directed">')
        # Longer ids hold greater numbers.
        for r in nodes.orderBy(F.length("node_id"), "node_id").toLocalIterator():
            counts[0] += 1
            f.write(f'<node id="{r.node_id}"><data key="d0">{r.kind}</data><data key="d1">{_text(r.label)}</data></node>')
        for r in edges.orderBy(F.length("edge_id"), "edge_id").toLocalIterator():
            counts[1] += 1
            f.write(f'<edge id="{r.edge_id}" source="{r.s}" target="{r.t}"><data key="d2">{_text(r.predicate)}</data></edge>')
        f.write("</graph></graphml>")
    return counts[0], counts[1]


def write_pages(pages: DataFrame, folder: Path) -> int:
    """One file per page (relative_path, markdown), each with a line end."""
    n = 0
    for r in pages.select("relative_path", "markdown").toLocalIterator():
        target = folder / r.relative_path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(r.markdown + "\n", encoding="utf-8")
        n += 1
    return n


def manifest(published: Published, branches: dict[str, str], milliseconds: int) -> dict:
    return {
        "runId": published.run_id, "succeeded": published.succeeded, "headBranch": branches.get("head") or "unknown", "mainlineBranch": branches.get("mainline") or "unknown",
        "durationMs": max(0, milliseconds), "pageCount": published.pages, "nodeCount": published.nodes, "edgeCount": published.edges, "promoted": published.promoted,
        "diagnostics": [{"code": c, "count": n} for c, n in sorted(published.diagnostics.items())],
    }


def promote(run: Path, latest: Path) -> None:
    """Put a copy of a run in place of `latest`; the old one comes back if that fails."""
    mark = uuid.uuid4().hex
    staged, backup = latest.with_name(f".{latest.name}-new-{mark}"), latest.with_name(f".{latest.name}-old-{mark}")
    shutil.copytree(run, staged)
    moved = False
    try:
        if latest.exists():
            latest.rename(backup)
            moved = True
        staged.rename(latest)
    except OSError:
        if moved and not latest.exists():
            backup.rename(latest)
        raise
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    shutil.rmtree(backup, ignore_errors=True)


def publish(triples: DataFrame, pages: DataFrame, diagnostics: DataFrame, output: Path, failed: bool = False, violations: Iterable[str] = (), branches: dict[str, str] | None = None, now: datetime | None = None, repository_id: str | None = None) -> Published:
    """Write a run's artefacts under output/runs/<id>; promote it to output/latest unless the run failed or links are broken.

    Branches that are not given are looked up in the triples of the repository.
    """
    if branches is None and repository_id is not None:
        branches = {"head": branch_of(triples, repository_id, "headBranch"), "mainline": branch_of(triples, repository_id, "mainlineBranch")}
    began = now or datetime.now(timezone.utc)
    out = Published(run_id(began), True)
    folder = output / "runs" / out.run_id
    try:
        folder.mkdir(parents=True, exist_ok=True)
        out.diagnostics = {r.code: r["count"] for r in diagnostics_by_code(diagnostics).collect()}  # one row per code
        broken = list(violations)
        if broken:
            raise ValueError(report(broken))
        out.pages = 0 if failed else write_pages(pages, folder / "wiki")
        out.nodes, out.edges = write_graphml(triples, folder / "graph.graphml")
        if not failed:
            promote(folder, output / "latest")
            out.promoted = True
    except (OSError, ValueError) as error:
        out.succeeded, out.reason = False, str(error)
    spent = int((datetime.now(timezone.utc) - began).total_seconds() * 1000)
    text = json.dumps(manifest(out, branches or {}, spent), indent=2)
    (folder / "manifest.json").write_text(text)
    if out.promoted:
        (output / "latest" / "manifest.json").write_text(text)
    return out


def publish_nothing(*_, **__) -> Published:
    """A publisher that writes nothing and succeeds."""
    return Published("", True)


def no_run(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A run that finds nothing: no triples and no diagnostics."""
    return spark.createDataFrame([], TRIPLES), spark.createDataFrame([], "code string, message string")


def report(violations: list[str], most: int = 20) -> str:
    """The first violations in order and how many more there are."""
    shown = sorted(violations)[: max(1, most)]
    rest = len(violations) - len(shown)
    return "\n".join([f"{len(violations)} broken page invariants:", *shown, *([f"... and {rest} more"] if rest else [])])
