"""Repository addresses and package addresses as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
#: Group id prefixes of code hosts, whose third label names the owner (fixed values).
CODE_HOST_GROUPS = ("com.github", "io.github", "org.github", "com.gitlab", "io.gitlab", "org.gitlab", "com.bitbucket", "io.bitbucket", "org.bitbucket")


def remote_url(url: Column, hosts: Sequence[str] = HOSTS) -> Column:
    """``https://host/owner/name`` of an http, ftp, ssh or scp-like remote on an allowed host, else null.  Ports and what follows the name are dropped."""
    u = F.regexp_replace(F.trim(url), r"^(?:scm:)?(?:git:)?(?=(?:git\+)?(?:https?|ftps?|ssh)\b|git@)", "")
    web = r"^(?:git\+)?(?:https?|ftps?)://([^/:@?#]+)/+([^/?#]+)/+([^/?#]+)"
    ssh = r"^(?:git\+)?ssh://[^/@]+@([^/:]+)(?::[0-9]+)?[:/]+([^/?#]+)/+([^/?#]+)"
    scp = r"^[^/@:]+@([^/:]+):(?:[0-9]+/)?/*([^/?#]+)/+([^/?#]+)"
    out = F.lit(None).cast("string")
    for p in (scp, ssh, web):
        host = F.regexp_extract(u, p, 1)
        out = F.when(u.rlike(p) & host.isin(*hosts), F.concat(F.lit("https://"), host, F.lit("/"), F.regexp_extract(u, p, 2), F.lit("/"), F.regexp_replace(F.regexp_extract(u, p, 3), r"\.git$", ""))).otherwise(out)
    return out


def full_name(remote: Column) -> Column:
    """``owner/name`` of a normalised remote."""
    return F.nullif(F.regexp_extract(remote, r"^https://[^/]+/([^/]+/[^/]+)$", 1), F.lit(""))


def complete_name_parts(name: Column) -> Column:
    """type, owner and name of ``type/owner/name`` or ``type/name``; null for any other number of parts."""
    p = F.split(name, "/")
    n = F.size(p)
    return F.when(n == 3, F.struct(p[0].alias("type"), p[1].alias("owner"), F.element_at(p, 3).alias("name"))).when(n == 2, F.struct(p[0].alias("type"), F.lit(None).cast("string").alias("owner"), p[1].alias("name")))


_PURL = r"^pkg:/*([A-Za-z][A-Za-z0-9.+-]*)/(?:([^@?#]*)/)?([^/@?#]+)(?:@([^?#]+))?(?:\?([^#]*))?(?:#(.*))?$"


def parse_purl(purl: Column) -> Column:
    """type, namespace, name, version, qualifiers and subpath; null if it is no package address."""
    def part(n: int) -> Column:
        x = F.regexp_extract(purl, _PURL, n)
        return F.when(x != "", x)

    return F.when(
        purl.rlike(_PURL),
        F.struct(F.lower(part(1)).alias("type"), part(2).alias("namespace"), part(3).alias("name"), part(4).alias("version"), part(5).alias("qualifiers"), part(6).alias("subpath")),
    )


def purl_equivalent(a: Column, b: Column) -> Column:
    """Equal type, namespace and name; the version counts only where both have one."""
    x, y = parse_purl(a), parse_purl(b)
    return (x["type"] == y["type"]) & x["namespace"].eqNullSafe(y["namespace"]) & (x["name"] == y["name"]) & (x["version"].isNull() | y["version"].isNull() | (x["version"] == y["version"]))


def purl_path(purl: Column) -> Column:
    """Relative folder of a package: type, namespace and name, sanitised."""
    p = parse_purl(purl)
    return F.concat_ws("/", *[sanitise(p[c]) for c in ("type", "namespace", "name")])


def sanitise(name: Column) -> Column:
    """File name: everything but letters, digits and hyphens becomes an underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9-]", "_")


def same_repository_key(url: Column) -> Column:
    """Equal for addresses with the same host and path."""
    host = F.lower(F.regexp_extract(url, r"^[a-z+]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z+]+://[^/?#]+(/[^?#]*)", 1), r"(?:\.git)?/*$", "")
    return F.concat(host, path)


#: Whitespace, quotes, brackets and closing marks around a name.
_AROUND = r"""(?U)^[\s"'()<>\[\]{},;!]+|[\s"'()<>\[\]{},;!]+$"""


def organisation(group_id: Column) -> Column:
    """The labels of a group id that name its organisation: two, or three on a code host.

    Whitespace around the id and its labels, marks that enclose or end it, and empty labels do not count.  A name without
    a dot (``@scope`` too) is its own organisation; one without any label gives the empty text.
    """
    bare = F.regexp_replace(F.lower(group_id), _AROUND, "")
    labels = F.filter(F.split(bare, r"(?U)\s*\.\s*"), lambda x: x != "")
    head = F.concat_ws(".", F.slice(labels, 1, 2))
    return F.when(head.isin(*CODE_HOST_GROUPS), F.concat_ws(".", F.slice(labels, 1, 3))).otherwise(head)


def clean_spdx_uri(uri: Column) -> Column:
    """Source address without the version control prefix and revision."""
    return F.regexp_replace(F.regexp_replace(uri, r"^git\+", ""), r"@[^/@]*(?:/[^@]*)?$", "")


def is_commit_hash(c: Column) -> Column:
    return c.rlike("^[a-f0-9]{7,40}$")


#: Ecosystem of a package address to the host its sources or files are served from (fixed values).
TYPE_DOMAINS = {"github": "github.com", "gitlab": "gitlab.com", "bitbucket": "bitbucket.org", "maven": "repo1.maven.org", "pypi": "pypi.org", "npm": "registry.npmjs.org"}


def purl_domain(purl: Column) -> Column:
    """Host of a package address by its type; null for unknown types."""
    return F.create_map(*[F.lit(x) for kv in TYPE_DOMAINS.items() for x in kv])[parse_purl(purl)["type"]]
