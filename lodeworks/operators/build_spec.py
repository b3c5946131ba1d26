"""Build specifications: the best commands and tools of a component, its toolchain and its report documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeworks.operators.relational import best_command_per_tool, fallback_chain

#: Build command by tool (fixed values).
DEFAULT_COMMANDS: Mapping[str, str] = {
    "maven": "mvn clean package",
    "gradle": "gradle clean assemble publishToMavenLocal",
    "pip": "python -m build --wheel -n",
    "poetry": "poetry build",
    "flit": "flit build",
    "hatch": "hatch build",
    "conda": "python -m build",
}


def command_list(text: Column) -> Column:
    """Commands of a JSON list in a text column, null if it is none."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>"))


def build_commands(as_code: DataFrame, service: DataFrame, script: DataFrame) -> DataFrame:
    """Best command per tool of the first source that has one: build as code, build service, build script.

    Each source: ``(id, component_id, build_tool_name, confidence, command)``; unreadable commands count as none.
    """
    sources = [s.withColumn("args", command_list(F.col("command"))).where(F.size("args") > 0) for s in (as_code, service, script)]
    return best_command_per_tool(fallback_chain(sources, "component_id"))


def compose(args: Column) -> Column:
    """Commands joined into one shell line."""
    return F.concat_ws(" && ", args)


def default_command(tool: Column) -> Column:
    return F.coalesce(*[F.when(tool == k, v) for k, v in DEFAULT_COMMANDS.items()])


def merge_requirements(reqs: DataFrame, key: str, name: str, version: str, order: str) -> DataFrame:
    """``(key, requirements)``: each name once, sorted; the first version that is given."""
    one = reqs.groupBy(key, name).agg(F.min_by(F.col(version), F.when(F.col(version).isNotNull(), F.col(order))).alias("v"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.concat(F.col(name), F.coalesce("v", F.lit(""))))).alias("requirements"))


def python_constraints(df: DataFrame, key: str, source: str, constraint: str) -> DataFrame:
    """``(key, constraints)``: those of dependencies if there are any, else of the release, its wheels and its project file."""
    dep = F.array_sort(F.collect_set(F.when(F.col(source) == "dependency", F.col(constraint))))
    own = F.array_sort(F.collect_set(F.when(F.col(source) != "dependency", F.col(constraint))))
    return df.groupBy(key).agg(F.when(F.size(dep) > 0, dep).otherwise(own).alias("constraints"))


def wheel_tags(filename: Column) -> Column:
    """python, abi and platform tags of a wheel's file name."""
    p = r"^.+-([^-]+)-([^-]+)-([^-]+)\.whl$"
    return F.when(filename.rlike(p), F.struct(*[F.regexp_extract(filename, p, i).alias(n) for i, n in ((1, "python"), (2, "abi"), (3, "platform"))]))


def wheel_generator(line: Column) -> Column:
    """Backend and version of a wheel's generator line."""
    p = r"(?i)^\s*(?:Generator:\s*)?([A-Za-z0-9_.-]+)\s*\(?([0-9][0-9A-Za-z.]*)?\)?\s*$"
    name = F.regexp_extract(line, p, 1)
    return F.when(line.rlike(p), F.struct(F.when(name == "bdist_wheel", "wheel").otherwise(name).alias("backend"), F.nullif(F.regexp_extract(line, p, 2), F.lit("")).alias("version")))


def patch_options(options: Column, patch: Column) -> Column:
    """Options with a patch applied: null values remove an option, others set it."""
    return F.map_filter(F.map_concat(F.map_filter(options, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch), lambda k, v: v.isNotNull())


def command_uses(command: Column, tools: tuple[str, ...], args: tuple[str, ...]) -> Column:
    """The program is one of the tools and any argument one of the given ones."""
    program = F.element_at(F.split(command[0], "/"), -1)
    return program.isin(*tools) & F.arrays_overlap(F.slice(command, 2, F.greatest(F.size(command) - 1, F.lit(0))), F.array(*map(F.lit, args)))


def tool_accepts(purl_type: Column, tool_type: str, known: tuple[str, ...]) -> Column:
    """A tool is refused only if the type names another known ecosystem."""
    return ~(purl_type.isin(*known) & (purl_type != tool_type))


def first_config(files: DataFrame, key: str, path: str, names: tuple[str, ...]) -> DataFrame:
    """The shallowest, then alphabetically first configuration file of each repository."""
    f = files.where(F.element_at(F.split(path, "/"), -1).isin(*names)).withColumn("depth", F.size(F.split(path, "/")))
    w = Window.partitionBy(key).orderBy("depth", path)
    return f.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, path)


def spec_json(df: DataFrame) -> DataFrame:
    """Adds ``spec``: the row as a JSON document."""
    return df.withColumn("spec", F.to_json(F.struct(*df.columns)))


#: Tool to ecosystem and the names of its configuration files (fixed values).
TOOL_FILES: Mapping[str, tuple[str, tuple[str, ...]]] = {
    "maven": ("maven", ("pom.xml",)),
    "gradle": ("maven", ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")),
    "pip": ("pypi", ("pyproject.toml", "setup.py", "setup.cfg")),
    "poetry": ("pypi", ("pyproject.toml",)),
    "npm": ("npm", ("package.json",)),
    "yarn": ("npm", ("package.json",)),
    "go": ("golang", ("go.mod",)),
    "docker": ("docker", ("Dockerfile",)),
    "conda": ("pypi", ("meta.yaml",)),
}


def detected_tools(files: DataFrame, key: str, path: str, purl_type: str | None = None) -> DataFrame:
    """``(key, tool, path)``: every tool with a configuration file in a repository, at its shallowest, then first place.

    Tools of another known ecosystem than the package's are left out.
    """
    names = F.create_map(*[x for n in sorted({n for _, ns in TOOL_FILES.values() for n in ns}) for x in (F.lit(n), F.array(*[F.lit(t) for t, (_, ns) in TOOL_FILES.items() if n in ns]))])
    hit = files.withColumn("tool", F.explode(names[F.element_at(F.split(path, "/"), -1)]))
    if purl_type:
        kind = F.create_map(*[F.lit(x) for t, (k, _) in TOOL_FILES.items() for x in (t, k)])[F.col("tool")]
        known = sorted({k for k, _ in TOOL_FILES.values()})
        hit = hit.where(~(F.col(purl_type).isin(*known) & (F.col(purl_type) != kind)) | F.col(purl_type).isNull())
    return hit.groupBy(key, "tool").agg(F.min_by(path, F.struct(F.size(F.split(path, "/")), F.col(path))).alias(path))


def project_matches(pom_group: Column, pom_artifact: Column, group: Column, artifact: Column) -> Column:
    """Does a project file belong to a package: both of its coordinates must be the ones asked for."""
    return F.coalesce((pom_group == group) & (pom_artifact == artifact), F.lit(False))


def pip_confidence(name: Column, build_backend: Column, hits_before: Column) -> Column:
    """Confidence that a configuration file is of a plain Python build.

    A project file without a build system, or one that names setuptools, is certain; with another it is half certain; any
    other file counts half once something was found.
    """
    project = F.when(build_backend.isNull() | build_backend.contains("setuptools"), 1.0).otherwise(0.5)
    return F.when(name == "pyproject.toml", project).otherwise(F.when(hits_before > 0, 0.5).otherwise(1.0))


def setuptools_inferred(metadata: Column) -> Column:
    """Metadata written by setuptools: it names its generator or lists its own fields."""
    return F.coalesce(metadata.rlike(r"(?m)^(?:License-File|Provides-Extra):") | metadata.contains("setuptools"), F.lit(False))


def rust_toolchain(backend: Column, requirements: Column, has_cargo: Column, toolchain: Column, rust_version: Column) -> Column:
    """Toolchain of a package with Rust parts: the channel of its toolchain file, else the least version its manifest asks for."""
    uses = F.coalesce(backend.rlike("maturin|setuptools_rust|setuptools-rust"), F.lit(False)) | F.coalesce(F.exists(requirements, lambda r: r.rlike("^(?:maturin|setuptools[-_]rust)")), F.lit(False)) | F.coalesce(has_cargo, F.lit(False))
    channel = F.coalesce(F.nullif(F.regexp_extract(toolchain, r"(?m)^\s*channel\s*=\s*\"([^\"]+)\"", 1), F.lit("")), F.when(~toolchain.contains("["), F.nullif(F.trim(toolchain), F.lit(""))))
    return F.when(uses, F.coalesce(channel, F.concat(F.lit(">="), rust_version), F.lit("stable")))


def best_tool_by_language(tools: DataFrame, key: str) -> DataFrame:
    """``(key, tool, confidence)``: of the tools for the package's language, the most certain one, then by name."""
    w = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "tool")
    return tools.where("tool_language = language").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, "tool", "confidence")


def rebuild_file(df: DataFrame) -> DataFrame:
    """Adds ``rebuild``: the shell-like specification of a rebuild, for rows ``(group, artifact, version, repository, tag, tool, jdk, command)``."""
    return df.withColumn("rebuild", F.format_string("groupId=%s\nartifactId=%s\nversion=%s\ngitRepo=%s\ngitTag=%s\ntool=%s\njdk=%s\nnewline=lf\ncommand=\"%s\"\n", "group", "artifact", "version", "repository", "tag", "tool", "jdk", "command"))
