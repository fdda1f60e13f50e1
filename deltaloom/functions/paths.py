"""Path semantics as Column expressions: language, category, role, risk, stems, topics.

Every rule set is a table of what a path may contain, start with, be named or
end with; ``matches`` turns a table into one boolean Column. Nothing here needs
Python on the executors.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------

#: extension -> language, case-sensitive
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "pyi": "Python", "go": "Go", "rs": "Rust", "java": "Java", "cs": "CSharp", "php": "Php", "rb": "Ruby",
    "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "c++": "Cpp",
    "hpp": "Cpp", "hxx": "Cpp", "h++": "Cpp", "hh": "Cpp", "scala": "Scala", "sc": "Scala",
}

#: keys of a rule: has = the lower-cased path contains; at = it starts with; dir = it has this directory,
#: at the start or below; name, name_at, name_end, name_has = of the file name; ext = its last extension
TRUE_INFRA = {
    "name_at": (".env", "dockerfile", "docker-compose", "pulumi.", "build.gradle", "tsconfig", "webpack.", "vite.", "rollup.", "esbuild.", "babel."),
    "name_end": (".env", ".snk", ".pfx", ".pem", ".tf", ".tfvars", ".csproj", ".mk"),
    "name_has": (".helmrelease.",),
    "name": (
        ".dockerignore", ".gitlab-ci.yml", "jenkinsfile", ".travis.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml",
        "package.json", "cargo.toml", "go.mod", "go.sum", "requirements.txt", "pipfile", "pyproject.toml", "gemfile", "pom.xml", "package.swift",
            "build.sbt", "composer.json",
        "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "gemfile.lock", "poetry.lock", "composer.lock",
        "makefile", "cmakelists.txt", "build.rs", ".mcp.json", ".tool-versions", ".nvmrc", ".node-version", ".python-version", ".ruby-version",
        ".gitignore", ".gitattributes", ".gitmodules", "codeowners",
    ),
    "has": (
        ".github/workflows/", ".circleci/", ".changeset/", ".changes/", "k8s/", "kubernetes/", "helm/", "terraform/", "pulumi/", "cdk/", "cloudformation/",
        ".vscode/", ".idea/", ".eclipse/", ".mcp/",
    ),
}
SQL_RESOURCES = {"has": ("/resources/db/",), "at": ("db/",)}
SCHEMA = {"dir": ("schemas/", "schema/", "types/"), "name_has": (".schema.", ".dto.")}
MIGRATION = {"dir": ("migrations/", "migrate/", "seeds/", "fixtures/"), "name_has": (".migration.",)}
SCRIPT = {"ext": ("sh", "bash", "zsh", "ps1"), "dir": ("scripts/",)}
DEPLOYMENT = {"dir": ("deploy/", "deployment/")}
DOCUMENTATION = {"ext": ("md", "mdx", "rst", "txt"), "dir": ("docs/", "documentation/")}
SITE_CONTENT = {"at": ("docs/content/", "content/", "www/docs/")}
INLINE_DOC_DIRS = {"has": ("/src/docs/", "/resources/mdtest/")}
LINT = {
    "name_at": (".eslint", ".prettier", ".stylelint"),
    "name": (".editorconfig", ".clang-format", "rustfmt.toml", ".rubocop.yml", ".flake8", "mypy.ini", ".golangci.yml"),
}
TEST_UTIL = {"has": ("/test-utils/", "/test-helpers/", "/__fixtures__/", "/test/fixtures/", "/testutils/")}
GENERATED = {"has": ("/generated/", "/__generated__/"), "name_has": (".generated.",), "name_end": (".g.dart", ".pb.go")}
CONFIG_LIKE = {
    "name": (
        "settings.py", "celeryconf.py", "urls.py", "wsgi.py", "asgi.py", "conftest.py", "manage.py", "setup.py", "setup.cfg",
        "rector.php", "phpstan.neon", "phpunit.xml", "phpunit.xml.dist",
        "version.go", "version.ts", "version.js", "version.py", "version.rb", "__version__.py", "version_current.go",
        "config.ts", "config.js", "config.mjs", "config.py", "config.go", "config.rs", "config.rb", "config.php", "config.java", "config.kt",
            "config.cs", "config.swift", "config.scala",
        "settings.ts", "settings.js", "seed.ts", "seed.js", "biome.json", "build.ts", "build.js", "build.mjs",
    ),
    "name_at": ("zz_generated",), "name_has": (".config.",), "name_end": (".proto", ".pb.go"),
    "has": ("/swagger/", "/openapi/", "/migrations/"), "dir": ("pkg/brew/", "vendor/", "third_party/"), "at": ("scripts/", "node_modules/"),
}
ROOT_DOCS = ("readme.md", "changelog.md", "changelog.rst", "contributing.md", "license.md", "security.md", "authors.md", "code_of_conduct.md",
    "changes.rst", "history.md", "releases.md")
ANY_DEPTH_DOCS = ("readme.md", "changelog.md", "changelog.rst")
API_DOCS = ("docs/api.md", "docs/api.mdx", "docs/api.rst", "docs/api.txt")
LANDING_SECTIONS = ("docs/user/", "docs/community/")
DOC_EXTENSIONS = ("md", "mdx", "rst", "txt")
ROLES = (
    ("Handler", ("handler", "controller", "route")), ("Service", ("service",)), ("Repository", ("repo", "repository", "dal")), ("Model", ("model", "schema", "entity")),
    ("Config", ("config", "setting")), ("Test", ("test", "spec")), ("Utility", ("util", "helper", "lib")),
)
RISK_SCHEMA = {"has": ("schema", "migration"), "end": (".sql",)}
RISK_AUTH = {"has": ("auth", "security", "permission", "rbac", "acl")}
RISK_API = {"has": ("api/", "routes/", "handlers/", "endpoints/")}
RISK_TEST = {"has": (".test.", ".spec.", "__tests__"), "at": ("test/", "tests/")}
TEST_FILE = {
    "name_has": (".test.", ".spec.", ".vitest.", "_test.", ".e2e.", ".integration-test."), "name_at": ("test_",),
    "has": ("/tests/", "/test/", "/__tests__/", "/testscripts/", "/testdata/", "/specs/"), "at": ("tests/", "test/", "testscripts/", "specs/"),
}
TEST_INFIXES = (".test.", ".spec.", ".vitest.", "_test.", ".e2e.", ".integration-test.")
GENERIC_STEMS = ("package", "changelog", "readme", "license", "index", "mod", "lib", "main", "init", "__init__", "version", "setup", "config", "tsconfig")
GENERIC_TOPICS = (
    "docs", "doc", "documentation", "content", "tutorial", "tutorials", "guide", "guides", "reference", "references", "advanced", "example", "examples",
    "sample", "samples", "site", "www", "src", "test", "tests", "resources", "mdtest", "how", "with", "and",
)
WORKSPACE_ROOTS = ("apps", "packages", "services", "workers", "libs", "modules", "crates")
CONTAINERS = ("services", "workers", "libs", "modules", "packages", "features", "domains", "core", "shared", "ui")
FALLBACK_DOCS = {"dir": ("documentation/docs/", "www/docs/", "content/docs/", "site/content/"), "at": ("docs/tutorial/", "docs/advanced/")}
CODE_DOCS = {"has": ("/src/docs/", "/resources/mdtest/"), "dir": ("docs_src/",),
    "at": ("docs/tutorial/", "docs/advanced/", "docs/how-to/", "docs/guide/", "docs/guides/", "docs/reference/")}
LOCALIZED_DOCS = r"^docs/[a-z-]{2,8}/docs/"
PARTITION_NAMES = {
    "Infrastructure": "infrastructure", "Schema": "schema", "Script": "script", "Migration": "migration", "Deployment": "deployment",
    "Documentation": "documentation", "Lint": "lint", "TestUtil": "test-util", "Generated": "generated",
}
CATEGORY_TITLES = {
    "Infrastructure": "Infrastructure", "Schema": "Schemas", "Script": "Scripts", "Migration": "Migrations", "Deployment": "Deployment", "Documentation": "Documentation",
    "Lint": "Lint", "TestUtil": "Test utilities", "Generated": "Generated", "DirectoryGroup": "Directory group", "Unclassified": "Unclassified",
}
GROUP_SUFFIXES = {
    "HttpRoute": "route", "CliCommand": "CLI", "QueueConsumer": "consumer", "CronJob": "scheduled", "ReactPage": "page", "TestFile": "test",
    "EventHandler": "event", "EffectService": "Effect service",
}
# --- end of fixed values ----------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(parts) -> Column:
    return reduce(or_, parts, F.lit(False))


def _lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def file_name(path) -> Column:
    return F.substring_index(_c(path), "/", -1)


def extension(path) -> Column:
    """What follows the last dot of the file name; the whole name without a dot."""
    return F.substring_index(file_name(path), ".", -1)


def directory(path) -> Column:
    """Everything before the last slash, '' for a file at the root."""
    return F.regexp_extract(_c(path), r"^(.*)/[^/]*$", 1)


def parent_dir(path) -> Column:
    """As ``directory``, '.' for a file at the root."""
    return F.when(F.contains(_c(path), F.lit("/")), directory(path)).otherwise(F.lit("."))


def matches(path, rule: dict) -> Column:
    """Whether the lower-cased path meets any entry of the rule."""
    low = F.lower(_c(path))
    name, ext = file_name(low), extension(low)
    lit = F.lit
    tests = {
        "has": lambda v: F.contains(low, lit(v)), "at": lambda v: F.startswith(low, lit(v)), "end": lambda v: F.endswith(low, lit(v)),
        "dir": lambda v: F.contains(low, lit("/" + v)) | F.startswith(low, lit(v)),
        "name_at": lambda v: F.startswith(name, lit(v)), "name_end": lambda v: F.endswith(name, lit(v)), "name_has": lambda v: F.contains(name, lit(v)),
    }
    parts = [tests[k](v) for k, vs in rule.items() if k in tests for v in vs]
    parts += [name.isin(*rule["name"])] if "name" in rule else []
    parts += [ext.isin(*rule["ext"])] if "ext" in rule else []
    return _any(parts)


def language(path) -> Column:
    return _lookup(F.substring_index(_c(path), ".", -1), LANGUAGES, "Unknown")


def is_true_infrastructure(path) -> Column:
    return matches(path, TRUE_INFRA)


def category(path) -> Column:
    """One of eleven categories; the order of the branches decides."""
    low = F.lower(_c(path))
    name, ext = file_name(low), extension(low)
    inline = ext.isin("md", "mdx") & matches(path, INLINE_DOC_DIRS)
    return (
        F.when(is_true_infrastructure(path) | (name == "application.properties"), "Infrastructure")
        .when(F.endswith(name, F.lit(".sql")) & matches(path, SQL_RESOURCES), "Migration")
        .when(matches(path, SCHEMA), "Schema").when(matches(path, MIGRATION), "Migration").when(matches(path, SCRIPT), "Script")
        .when(matches(path, DEPLOYMENT), "Deployment").when(~matches(path, SITE_CONTENT) & ~inline & matches(path, DOCUMENTATION), "Documentation")
        .when(matches(path, LINT), "Lint").when(matches(path, TEST_UTIL), "TestUtil").when(matches(path, GENERATED), "Generated")
        .otherwise("Unclassified")
    )


def is_config_like(path) -> Column:
    low = F.lower(_c(path))
    theme = F.contains(low, F.lit("/themes/")) & F.startswith(file_name(low), F.lit("theme-"))
    fixture = F.contains(low, F.lit("/fixtures/")) & ~F.contains(low, F.lit("/src/"))
    return matches(path, CONFIG_LIKE) | theme | fixture


def is_top_level_doc(path) -> Column:
    low = F.lower(_c(path))
    landing = _any(F.startswith(low, F.lit(s)) & (F.size(F.split(low, "/")) == s.count("/") + 1) & F.substring_index(low, ".",
        -1).isin(*DOC_EXTENSIONS) for s in LANDING_SECTIONS)
    root = ~F.contains(low, F.lit("/")) & low.isin(*ROOT_DOCS)
    return low.isin(*API_DOCS) | landing | root | file_name(low).isin(*ANY_DEPTH_DOCS)


def is_root_docs_page(path) -> Column:
    """A page directly under docs/, not localized and no landing page."""
    low = F.lower(_c(path))
    return ~is_top_level_doc(path) & ~low.rlike(LOCALIZED_DOCS) & low.rlike(r"^docs/[^/]*$") & F.substring_index(low, ".", -1).isin(*DOC_EXTENSIONS)


def is_doc_fallback(path, root_docs: Column) -> Column:
    """A document that describes code and may go to the largest group; ``root_docs`` counts the root pages of its change."""
    low = F.lower(_c(path))
    text = F.substring_index(low, ".", -1).isin(*DOC_EXTENSIONS) & ~is_top_level_doc(path) & ~low.rlike(LOCALIZED_DOCS)
    return text & (matches(path, FALLBACK_DOCS) | (is_root_docs_page(path) & (root_docs >= 3)))


def is_code_doc(path, root_docs: Column) -> Column:
    low = F.lower(_c(path))
    text = F.substring_index(low, ".", -1).isin(*DOC_EXTENSIONS) & ~is_top_level_doc(path) & ~low.rlike(LOCALIZED_DOCS)
    return text & (matches(path, CODE_DOCS) | is_doc_fallback(path, root_docs))


def role(path) -> Column:
    low = F.lower(_c(path))
    out = F.lit("Infrastructure")
    for name, words in reversed(ROLES):
        out = F.when(_any(F.contains(low, F.lit(w)) for w in words), name).otherwise(out)
    return out


def risk_flags(path) -> dict[str, Column]:
    return {
        "is_schema": matches(path, RISK_SCHEMA), "is_auth": matches(path, RISK_AUTH), "is_api": matches(path, RISK_API), "is_test": matches(path, RISK_TEST),
    }


def is_test_file(path) -> Column:
    stem = F.regexp_replace(file_name(F.lower(_c(path))), r"\.[^.]*$", "")
    return matches(path, TEST_FILE) | stem.rlike("(test|tests|spec)$")


def _untested(name: Column, infixes=TEST_INFIXES) -> Column:
    """The file name without test infixes, extension and leading ``test_``."""
    for x in infixes:
        name = F.replace(name, F.lit(x), F.lit("."))
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^test_", "")


def bare_stem(path) -> Column:
    """Lower-cased stem that a test and its implementation share; '' for generic names."""
    low = F.regexp_replace(F.lower(_untested(file_name(path))), "(tests|test|spec)$", "")
    return F.when(low.isin(*GENERIC_STEMS), "").otherwise(low)


def test_impl_stem(path) -> Column:
    """``last two directories:stem``; suffixes are case-sensitive here."""
    stem = F.regexp_replace(_untested(file_name(path), (*TEST_INFIXES, "_bench_test.")), "(Tests|Test|Spec)$", "")
    return F.concat(F.regexp_extract(directory(path), r"([^/]*/)?[^/]*$", 0), F.lit(":"), stem)


def dir_prefix(path, depth: int) -> Column:
    """The first ``depth`` directories; null if there are fewer; depth 0: '' for files at the root only."""
    parts = F.split(_c(path), "/")
    if depth == 0:
        return F.when(F.size(parts) == 1, "")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))


def topic_tokens(path) -> Column:
    """Distinct words of the stem and the last three directories, nearest first."""
    near = F.reverse(F.slice(F.reverse(F.split(directory(F.lower(_c(path))), "/")), 1, 3))
    text = F.concat_ws(" ", bare_stem(path), F.array_join(F.reverse(near), " "))
    words = F.transform(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: F.regexp_replace(w, "^[0-9]+", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_TOPICS)))


def partition_key(path) -> dict[str, Column]:
    """``is_infra`` and ``bucket`` by which a very large change is dealt."""
    parts = F.split(_c(path), "/")
    one, two, three = (F.get(parts, F.lit(i)) for i in range(3))
    kind = category(path)
    infra = is_config_like(path) | (kind != "Unclassified")
    plain = lambda x: x.isNotNull() & ~F.contains(x, F.lit("."))
    bucket = (
        F.when(is_config_like(path), "config-like").when(kind != "Unclassified", _lookup(kind, PARTITION_NAMES, "unclassified"))
        .when(one == "", "root")
        .when(one.isin(*WORKSPACE_ROOTS) & plain(two) & plain(three) & two.isin(*CONTAINERS), F.concat_ws("/", one, two, three))
        .when(one.isin(*WORKSPACE_ROOTS) & plain(two), F.concat_ws("/", one, two))
        .otherwise(one)
    )
    return {"is_infra": infra, "bucket": bucket}


def normalize(path) -> Column:
    """Folds '.', '' and '..' segments; '..' above the root is dropped."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(F.split(_c(path), "/"), empty, lambda acc, s: (
        F.when(s.isin(".", ""), acc).when(s == "..",
            F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))))
    return F.array_join(folded, "/")


def relative_import(source) -> Column:
    """Dotted relative imports as paths: '.a.b' -> './a/b', '..a' -> '../a'; '' dots: as it is."""
    s = _c(source)
    dots = F.length(F.regexp_extract(s, r"^(\.*)", 1))
    rest = F.replace(F.substr(s, dots + 1), F.lit("."), F.lit("/"))
    up = F.when(dots == 1, ".").otherwise(F.regexp_replace(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), "/$", ""))
    return F.when(dots == 0, s).when(rest == "", up).otherwise(F.concat(up, F.lit("/"), rest))


def file_stem(path) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(file_name(path), ".", 1)


def short_label(path) -> Column:
    """The last two segments."""
    return F.substring_index(_c(path), "/", -2)


def group_name(file, symbol, kind) -> Column:
    """A review group's title from its entry point."""
    stem, symbol = file_stem(file), _c(symbol)
    label = F.when((symbol == stem) | symbol.isin("default", "module"), stem).otherwise(F.concat(symbol, F.lit(" ("), stem, F.lit(")")))
    return F.concat_ws(" ", label, _lookup(_c(kind), GROUP_SUFFIXES, ""))


# fixed values: extensions of sources within fixture trees, and what counts as source elsewhere besides
FIXTURE_SOURCES = ("go", "rs", "ts", "tsx", "js", "jsx", "py", "java", "kt", "rb", "php", "cs", "swift", "scala", "vue", "svelte", "astro", "c", "h",
    "cc", "cpp", "cxx", "hh", "hpp")
SOURCES = tuple(e for e in FIXTURE_SOURCES if e != "astro") + ("tmpl", "html", "css", "scss", "md", "mdx", "rst")
FIXTURE_PROJECT_FILES = (".gitignore", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "turbo.json")


def _extension(path) -> Column:
    return F.lower(F.substring_index(_c(path), ".", -1))


def has_source_extension(path) -> Column:
    return _extension(path).isin(*SOURCES)


def fixture_root(path) -> Column:
    """The directory below the first ``fixtures`` directory, or that directory itself for files right in it; null outside."""
    p = _c(path)
    head = F.regexp_extract(p, r"(?i)^((?:.*?/)?fixtures/)", 1)
    rest = F.substr(p, F.length(head) + 1)
    segment = F.substring_index(rest, "/", 1)
    inner = F.when(segment != "", F.concat(head, segment))
    own = F.when(rest != "", F.substr(head, F.lit(1), F.length(head) - 1))
    return F.when(head != "", F.when(F.contains(rest, F.lit("/")), inner).otherwise(own))


def is_fixture_source(path) -> Column:
    return fixture_root(path).isNotNull() & _extension(path).isin(*FIXTURE_SOURCES)


def is_fixture_project(path) -> Column:
    """Project files of a fixture tree."""
    name = F.lower(file_name(path))
    return fixture_root(path).isNotNull() & (name.isin(*FIXTURE_PROJECT_FILES) | (name.startswith("tsconfig") & name.endswith(".json")))
