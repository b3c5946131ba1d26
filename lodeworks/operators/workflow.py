"""Workflow-security findings over flattened CI workflows.

Input: one row per step, ``(workflow, triggers array<string>, workflow_permissions, job, job_permissions, runs_on, step,
uses, ref_arg, run)``; permissions are texts such as ``write-all`` or lines of ``scope: level``.  Output:
``(workflow, job, step, finding, detail, priority)``: job and step are null for findings of a whole workflow, step for those
of a job; ``detail`` is the scope, job, action, reference or command line meant, and an issue comes once.

All detectors are columns.  Shell text is read statement by statement: lines, continued ones joined, are cut at ``;``,
``&&``, ``||`` and ``|`` outside quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Finding and priority (fixed values).
PRIORITY = {
    "overbroad-permissions": 80,
    "self-hosted-runner": 60,
    "unpinned-third-party-action": 20,
    "untrusted-fork-code": 100,
    "pr-target-untrusted-checkout": 100,
    "remote-script-exec": 80,
    "potential-injection": 100,
    "missing-permissions": 60,
    "privileged-trigger": 80,
    "known-vulnerability": 100,
}
RECOMMENDATION = {
    "overbroad-permissions": "Grant each job only the scopes it needs.",
    "self-hosted-runner": "Run untrusted code on hosted runners.",
    "unpinned-third-party-action": "Pin the action to a full commit hash.",
    "untrusted-fork-code": "Do not check out code of a fork in a privileged run.",
    "pr-target-untrusted-checkout": "Do not check out the head of a pull request under pull_request_target.",
    "remote-script-exec": "Download, verify and only then run scripts.",
    "potential-injection": "Pass untrusted values through environment variables.",
    "missing-permissions": "Declare permissions for the workflow or every job.",
    "privileged-trigger": "Use pull_request unless secrets are needed.",
    "known-vulnerability": "Upgrade the action to a fixed version.",
}
#: References under which a checkout takes code of a fork (fixed values).
UNTRUSTED_REFS = ("${{ github.event.pull_request.head.ref }}", "${{ github.head_ref }}", "${{ github.event.pull_request.head.sha }}", "${{ github.event.pull_request.head.repo.full_name }}")
#: Values an outsider controls (fixed values).
ATTACKER_CONTROLLED = ("github.event.pull_request.head.ref", "github.head_ref", "github.event.issue.body", "github.event.comment.body")
#: Findings that make ``pull_request_target`` dangerous (fixed values).
RISKY = ("overbroad-permissions", "untrusted-fork-code", "remote-script-exec", "pr-target-untrusted-checkout", "potential-injection", "self-hosted-runner")
#: A word without quotes, expansions and operators.
_PLAIN = r"[^\s|;&$`\"'()<>]+"
_REDIRECT = r"[0-9]?>{1,2}&?[^\s|;&]+"
_EXPRESSION = r"\$\{\{(?:(?!\}\}).)*\}\}"
#: A download piped straight into a shell or an unpacker: the first two commands of a pipeline, in plain words.
_REMOTE_EXEC = rf"^(?:\S*/)?(?i:curl|wget)(?:\s+(?:{_PLAIN}|{_REDIRECT}))*\s*\|&?\s*(?:(?:[^\s|]*/)?(?i:sudo|env|command)\s+)?(?:[^\s|]*/)?(?i:bash|sh|tar)(?:\s+(?:{_PLAIN}|{_REDIRECT}))*\s*(?:\||$)"
_ASSIGNMENT = r"^(?:export\s+)?[A-Za-z_]\w*=\S*$"


def statements(run: Column) -> Column:
    """Statements of a script, pipelines whole: continued lines joined, comments dropped, cut outside quotes and expressions."""
    joined = F.regexp_replace(run, r"\\\r?\n", " ")
    lines = F.regexp_extract_all(joined, F.lit(rf"((?:{_EXPRESSION}|\"(?:[^\"\\]|\\.)*\"|'[^']*'|\|(?!\|)|&(?!&)|[^\n;|&\"']|[\"'])+)"), F.lit(1))
    bare = F.transform(lines, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"(?:^|\s)#.*$", "")), r"^(?:(?:if|elif|while|until|then|else|do|!|\{|\()\s+)+", ""))
    return F.filter(bare, lambda x: x != "")


def injections(run: Column) -> Column:
    """Statements with an argument that holds a value an outsider controls; a bare assignment has no argument."""
    def tainted(x: Column) -> Column:
        return F.arrays_overlap(expressions(x), F.array(*map(F.lit, ATTACKER_CONTROLLED))) & ~F.regexp_replace(x, _EXPRESSION, "x").rlike(_ASSIGNMENT)

    return F.array_distinct(F.filter(statements(run), tainted))


def remote_scripts(run: Column) -> Column:
    """Pipelines that run what they download."""
    return F.array_distinct(F.filter(statements(run), lambda x: x.rlike(_REMOTE_EXEC)))


def flatten(df: DataFrame, path: str, document: str) -> DataFrame:
    """One row per step of workflows given as JSON documents (the columns that the detectors read).

    ``on`` may be a name, a list or an object; steps without an id are numbered.  Broken documents give no rows.
    """
    def text(v: str, p: str) -> Column:
        return F.try_variant_get(F.col(v), p, "string")

    def scopes(v: str) -> Column:
        m = F.try_variant_get(F.col(v), "$.permissions", "map<string,string>")
        return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n"), text(v, "$.permissions"))

    on = F.coalesce(F.try_variant_get("w", "$.on", "array<string>"), F.map_keys(F.try_variant_get("w", "$.on", "map<string,variant>")), F.array(text("w", "$.on")))
    w = df.select(F.col(path).alias("workflow"), F.try_parse_json(F.col(document)).alias("w")).where("w is not null")
    w = w.select("workflow", on.alias("triggers"), scopes("w").alias("workflow_permissions"), F.explode(F.try_variant_get("w", "$.jobs", "map<string,variant>")).alias("job", "j"))
    s = w.select("workflow", "triggers", "workflow_permissions", "job", scopes("j").alias("job_permissions"), text("j", "$.runs-on").alias("runs_on"), F.posexplode(F.try_variant_get("j", "$.steps", "array<variant>")).alias("n", "s"))
    return s.select(
        "workflow", "triggers", "workflow_permissions", "job", "job_permissions", "runs_on",
        F.coalesce(text("s", "$.id"), F.concat(F.lit("step"), "n")).alias("step"), text("s", "$.uses").alias("uses"), text("s", "$.with.ref").alias("ref_arg"), text("s", "$.run").alias("run"),
    )


def action_name(uses: Column) -> Column:
    return F.substring_index(uses, "@", 1)


def action_ref(uses: Column) -> Column:
    return F.when(uses.contains("@"), F.substring_index(uses, "@", -1))


def is_sha_pinned(uses: Column) -> Column:
    return F.coalesce(action_ref(uses).rlike("^[a-f0-9]{40}$"), F.lit(False))


def expressions(text: Column) -> Column:
    """Paths of ``github.…`` inside ``${{ … }}``, each once, in order."""
    inside = F.concat_ws(" ", F.regexp_extract_all(text, F.lit(r"\$\{\{(.*?)\}\}"), F.lit(1)))
    return F.array_distinct(F.regexp_extract_all(inside, F.lit(r"(github(?:\.[A-Za-z0-9_-]+)+)"), F.lit(1)))


def secrets_used(text: Column) -> Column:
    """Names of secrets that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"secrets\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))


def _issue(name: str, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("finding"), detail.cast("string").alias("detail"))


def step_findings(steps: DataFrame) -> DataFrame:
    """Findings of workflows, jobs and steps, each issue once; one ``privileged-trigger`` per workflow."""
    has = lambda t: F.array_contains("triggers", t)
    none = F.lit(None).cast("string")
    target = has("pull_request_target")
    uses, ref = F.col("uses"), F.trim("ref_arg")
    untrusted = (action_name(uses) == "actions/checkout") & ref.isin(*UNTRUSTED_REFS)
    unpinned = ~uses.startswith("./") & ~action_ref(uses).rlike("^[a-f0-9]{7,40}$")  # an action without a version is not judged
    when = lambda cond, name, detail: F.when(F.coalesce(cond, F.lit(False)), F.array(_issue(name, detail)))
    each = lambda texts, name: F.transform(texts, lambda x: _issue(name, x))
    empty = F.array().cast("array<struct<finding:string,detail:string>>")
    both = lambda *parts: F.flatten(F.array(*[F.coalesce(p, empty) for p in parts]))
    whole = F.lower(F.trim("workflow_permissions")) == "write-all"
    scopes = F.filter(F.split("workflow_permissions", "\n"), lambda x: x.contains(":") & F.lower(F.substring_index(x, ":", -1)).contains("write"))
    of_workflow = both(when(whole, "overbroad-permissions", F.col("workflow_permissions")), F.when(target, each(scopes, "overbroad-permissions")))
    of_job = both(when(F.col("runs_on").contains("self-hosted"), "self-hosted-runner", F.col("job")))
    # Most scripts are not read statement by statement: they lack what a finding needs.
    downloads = F.contains("run", F.lit("|")) & F.col("run").rlike("(?i)curl|wget")
    of_step = both(
        when(unpinned, "unpinned-third-party-action", uses), when(untrusted & has("pull_request"), "untrusted-fork-code", ref),
        when(untrusted & target, "pr-target-untrusted-checkout", ref), F.when(downloads, each(remote_scripts(F.col("run")), "remote-script-exec")),
        F.when(F.contains("run", F.lit("${{")), each(injections(F.col("run")), "potential-injection")),
    )
    placed = lambda issues, job, step: F.transform(issues, lambda x: F.struct(job.alias("job"), step.alias("step"), x["finding"].alias("finding"), x["detail"].alias("detail")))
    rows = F.concat(placed(of_workflow, none, none), placed(of_job, F.col("job"), none), placed(of_step, F.col("job"), F.col("step")))
    found = steps.select("workflow", target.alias("target"), F.explode(rows).alias("x")).select("workflow", "target", "x.*").distinct()
    # The risky findings of a workflow give one more row for it.
    risky = found.where(F.col("target") & F.col("finding").isin(*RISKY)).select("workflow").distinct()
    trigger = risky.select("workflow", none.alias("job"), none.alias("step"), F.lit("privileged-trigger").alias("finding"), F.lit("pull_request_target").alias("detail"))
    return with_priority(found.drop("target").unionByName(trigger))


def ordered_issues(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """``(workflow, issues)``: the issues of each workflow by falling priority, then by text."""
    one = F.struct((-F.col("priority")).alias("by"), F.concat_ws(": ", "finding", "detail").alias("issue"))
    issues = F.transform(F.array_sort(F.collect_set(one)), lambda x: x["issue"])
    return findings.groupBy("workflow").agg((F.slice(issues, 1, limit) if limit else issues).alias("issues"))


def advice(findings: DataFrame) -> DataFrame:
    """Findings with their recommendation."""
    return findings.withColumn("recommendation", F.create_map(*[F.lit(x) for kv in RECOMMENDATION.items() for x in kv])[F.col("finding")])


def workflow_findings(steps: DataFrame) -> DataFrame:
    """Findings of whole workflows: no permissions at the top and some job without any."""
    w = steps.groupBy("workflow").agg(F.max(F.col("workflow_permissions").isNull()).alias("top"), F.max(F.col("job_permissions").isNull()).alias("job"))
    return with_priority(w.where("top and job").select("workflow", F.lit(None).cast("string").alias("job"), F.lit(None).cast("string").alias("step"), F.lit("missing-permissions").alias("finding")))


def with_priority(f: DataFrame) -> DataFrame:
    return f.withColumn("priority", F.coalesce(*[F.when(F.col("finding") == k, v) for k, v in PRIORITY.items()]))


def dedupe(findings: DataFrame, keys: tuple[str, ...] = ("workflow", "finding")) -> DataFrame:
    """Each issue once, with its highest priority."""
    return findings.groupBy(*keys).agg(F.max("priority").alias("priority"))


def vulnerable_actions(steps: DataFrame, vulnerable: DataFrame) -> DataFrame:
    """Steps that use a vulnerable action, with all advisory links: ``vulnerable(action, version, url)``."""
    used = steps.where("uses is not null").select("workflow", "job", "step", action_name(F.col("uses")).alias("action"), action_ref(F.col("uses")).alias("version"), is_sha_pinned(F.col("uses")).alias("sha_pinned"))
    hit = used.join(vulnerable, ["action", "version"]).groupBy("workflow", "job", "step", "action", "version", "sha_pinned").agg(F.array_sort(F.collect_set("url")).alias("vuln_urls"))
    return with_priority(hit.withColumn("finding", F.lit("known-vulnerability")))


def first_keyword_line(lines: DataFrame, key: str, text: str, no: str, keywords: tuple[str, ...]) -> DataFrame:
    """The first line of each file that holds any keyword."""
    cond = F.lit(False)
    for k in keywords:
        cond = cond | F.col(text).contains(k)
    return lines.where(cond).groupBy(key).agg(F.min_by(text, no).alias("line"))


def job_edges(jobs: DataFrame) -> DataFrame:
    """``(workflow, parent, child)`` from ``needs``, matched without regard to case."""
    need = jobs.select("workflow", F.col("job").alias("child"), F.explode("needs").alias("n"))
    return need.join(jobs.select("workflow", F.col("job").alias("parent"), F.lower("job").alias("l")), (need["workflow"] == jobs["workflow"]) & (F.lower("n") == F.col("l"))).select(need["workflow"], "parent", "child")
