"""SQL renderings of the path rules for the oracle, apart from the Column form."""

from __future__ import annotations

from ..functions import calls, paths


def q(v: str) -> str:
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NAME = "regexp_extract(lower(path), '[^/]*$')"
EXT = "regexp_extract(lower(path), '[^./]*$')"
DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _pattern(values, lead: str, tail: str) -> str:
    import re

    return lead + "(" + "|".join(re.escape(v).replace("'", "''").replace("/", "/") for v in values) + ")" + tail


def rule(r: dict, path: str = "lower(path)") -> str:
    """One regular expression for each key of a rule."""
    shape = {
        "has": ("", ""), "at": ("^", ""), "end": ("", "$"), "dir": ("(^|/)", ""), "name": ("(^|/)", "$"), "name_at": ("(^|/)", "[^/]*$"),
        "name_end": ("", "$"), "name_has": ("", "[^/]*$"), "ext": (r"(^|[./])", "$"),
    }
    parts = [f"regexp_matches({path}, '{_pattern(v, *shape[k])}')" for k, v in r.items()]
    return "(" + " OR ".join(parts) + ")"


CATEGORY = f"""CASE
  WHEN {rule(paths.TRUE_INFRA)} OR {NAME} = 'application.properties' THEN 'Infrastructure'
  WHEN {NAME} LIKE '%.sql' AND {rule(paths.SQL_RESOURCES)} THEN 'Migration'
  WHEN {rule(paths.SCHEMA)} THEN 'Schema' WHEN {rule(paths.MIGRATION)} THEN 'Migration' WHEN {rule(paths.SCRIPT)} THEN 'Script' WHEN {rule(paths.DEPLOYMENT)} THEN 'Deployment'
  WHEN NOT {rule(paths.SITE_CONTENT)} AND NOT ({EXT} IN ('md', 'mdx') AND {rule(paths.INLINE_DOC_DIRS)}) AND {rule(paths.DOCUMENTATION)} THEN 'Documentation'
  WHEN {rule(paths.LINT)} THEN 'Lint' WHEN {rule(paths.TEST_UTIL)} THEN 'TestUtil' WHEN {rule(paths.GENERATED)} THEN 'Generated' ELSE 'Unclassified' END"""
CONFIG_LIKE = f"({rule(paths.CONFIG_LIKE)} OR (lower(path) LIKE '%/themes/%' AND {NAME} LIKE 'theme-%') OR (lower(path) LIKE '%/fixtures/%' AND lower(path) NOT LIKE '%/src/%'))"
TOP_DOC = (
    f"(lower(path) IN {names(paths.API_DOCS)} OR regexp_matches(lower(path), '^docs/(user|community)/[^/]*$') AND regexp_extract(lower(path), '[^.]*$') IN {names(paths.DOC_EXTENSIONS)} "
    f"OR lower(path) IN {names(paths.ROOT_DOCS)} OR {NAME} IN {names(paths.ANY_DEPTH_DOCS)})"
)
ROLE = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{'|'.join(w)}') THEN '{r}'" for r, w in paths.ROLES) + " ELSE 'Infrastructure' END"
LANGUAGE = "CASE regexp_extract(path, '[^.]*$') " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in paths.LANGUAGES.items()) + " ELSE 'Unknown' END"
TEST_FILE = f"({rule(paths.TEST_FILE)} OR regexp_matches(regexp_replace({NAME}, '\\.[^.]*$', ''), '(test|tests|spec)$'))"


def _untested(infixes) -> str:
    out = "regexp_extract(path, '[^/]*$')"
    for x in infixes:
        out = f"replace({out}, {q(x)}, '.')"
    return f"regexp_replace(regexp_replace({out}, '\\.[^.]*$', ''), '^test_', '')"


BARE = f"CASE WHEN regexp_replace(lower({_untested(paths.TEST_INFIXES)}), '(tests|test|spec)$', '') IN {names(paths.GENERIC_STEMS)} THEN '' ELSE regexp_replace(lower({_untested(paths.TEST_INFIXES)}), '(tests|test|spec)$', '') END"
IMPL = f"regexp_extract({DIR}, '([^/]*/)?[^/]*$', 0) || ':' || regexp_replace({_untested((*paths.TEST_INFIXES, '_bench_test.'))}, '(Tests|Test|Spec)$', '')"
TOPICS = f"""list_distinct(list_filter(list_transform(string_split(regexp_replace(
    lower(concat_ws(' ', {BARE}, array_to_string(list_reverse(list_slice(list_reverse(string_split(lower({DIR}), '/')), 1, 3)), ' '))), '[^a-z0-9]+', ' ', 'g'), ' '),
    lambda w: regexp_replace(w, '^[0-9]+', '')), lambda w: length(w) >= 3 AND w NOT IN {names(paths.GENERIC_TOPICS)}))"""

_M = "list_extract(string_split(callee, '.'), -1)"
_R = "lower(regexp_extract(callee, '^(.*)\\.[^.]*$', 1, 's'))"
_STORE = f"(length({_R}) > 1 AND {_R} NOT IN {names(calls.PLAIN_RECEIVERS)} AND regexp_matches({_R}, '{'|'.join(calls.STORE_WORDS)}'))"
_SQLW, _SQLR = ("(" + " OR ".join(f"contains(lower(callee), {q(w)})" for w in ws) + ")" for ws in (calls.SQL_WRITES, calls.SQL_READS))


def _word(words, ends) -> str:
    import re

    return f"regexp_matches(callee, '^({'|'.join(re.escape(w) for w in words)})($|[{ends}])')"


PATTERN = f"""CASE WHEN callee IN {names(calls.LOG_CALLS)} THEN 'Logging'
  WHEN regexp_matches(callee, '^(process[.]env|os[.]environ)') OR {_word(calls.CONFIG_CALLS, '.[')} THEN 'ConfigRead' WHEN {_word(calls.HTTP_CALLS, '.')} THEN 'HttpCall'
  WHEN {_M} IN {names(calls.COLLECTION_METHODS)} OR callee IN {names(calls.PLAIN_CALLS)} THEN NULL
  WHEN contains(callee, '.') AND {_M} IN {names(calls.EMIT_METHODS)} THEN 'EventEmission' WHEN contains(callee, '.') AND {_M} IN {names(calls.HANDLE_METHODS)} THEN 'EventHandling'
  WHEN (contains(callee, '.') AND {_M} IN {names(calls.WRITE_METHODS)} AND {_STORE}) OR {_SQLW} THEN 'Persistence'
  WHEN (contains(callee, '.') AND {_M} IN {names(calls.READ_METHODS)} AND {_STORE}) OR {_SQLR} THEN 'DatabaseRead' END"""
EDGE = "CASE pattern " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in calls.EDGE_OF_PATTERN.items()) + " END"
