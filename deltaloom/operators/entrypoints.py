"""Entry points of parsed files, by a table of rules.

A rule says which language it is for, what must (or must not) be imported,
which paths it covers, and whether calls, functions, exports or the file
itself give the symbol. All rules are evaluated over the nested facts of a
file; of one (file, symbol) the earliest rule stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

# --- fixed values -----------------------------------------------------------------
# Regular expressions. needs / unless: of an import's source; named: of an imported name;
# path / low: of the path as it is / lower-cased; calls, functions, exports: of the callee, the name.
JS, PY = ("TypeScript", "JavaScript"), ("Python",)
VERBS = "get|post|put|delete|patch|options|head"
WEB = {
    "TypeScript": r"^(express|fastify|@hapi/hapi|koa|@trpc/server|hono|@nestjs/common|@nestjs/core|next|nuxt|@remix-run/.*|sveltekit|restify|polka|@effect/platform)$",
    "Python": r"^((flask|fastapi|sanic|bottle|falcon)|(django|starlette|aiohttp|tornado|pyramid)(\..*)?)$",
    "Go": r"^(net/http|github\.com/gin-gonic/gin)$|^github\.com/(labstack/echo|go-chi/chi|gofiber/fiber|gorilla/mux)",
    "Rust": r"^(actix_web|actix-web|axum|rocket|warp|hyper|tower)(::|$)",
        "Java": r"^(org\.springframework\.web|javax\.ws\.rs|jakarta\.ws\.rs|io\.javalin|io\.micronaut\.http|io\.quarkus)",
    "CSharp": r"^(Microsoft\.AspNetCore|System\.Web\.Http|Carter|ServiceStack)",
        "Php": r"^(Illuminate\\Routing|Symfony\\Component\\Routing|Slim\\App)", "Ruby": r"^(sinatra|rails|grape|hanami|roda)$",
    "Kotlin": r"^(org\.springframework\.web|io\.ktor|io\.javalin|io\.micronaut\.http)", "Swift": r"^(Vapor|Kitura|Hummingbird)$",
        "Scala": r"^(akka\.http|http4s|play\.api|zio\.http|cask)",
}
WEB["JavaScript"] = WEB["TypeScript"]
CLI = {
    "TypeScript": r"^(commander|yargs|meow|cac|oclif|@effect/cli|inquirer|vorpal|caporal|clipanion)$", "Python": r"^(argparse|click|typer|fire|docopt|plac)$",
    "Go": r"^(github\.com/spf13/cobra|github\.com/urfave/cli|flag$)", "Rust": r"^(clap|structopt|argh|gumdrop)",
}
CLI["JavaScript"] = CLI["TypeScript"]
ROUTE_PATH = r"/(routes?|handlers?|controllers?|endpoints?)/|\.(routes?|handlers?|controllers?|endpoints?)\.[^/]*$"
STRONG_ROUTE_PATH = r"/(routes|handlers|controllers|endpoints)/|\.controllers?\.[^/]*$|entrypoint"
CLI_PATH = r"/(commands?|cmd|cli)/|\.(commands?|cli)\.[^/]*$"
MAIN_LANGUAGES = ("Python", "Go", "Rust", "Java", "CSharp", "Php", "Ruby", "Kotlin", "Swift", "C", "Cpp")
TEST_PATH = (
    r"(?i)\.(test|spec)\.|_test\.|__tests__/|/tests?/|^tests?/|_tests\.rs$", r"(^|/)test_[^/]*$", r"(^|/)(Test[^/]*|[^/]*Tests?)\.(?:java|kt)$",
        r"Tests?\.(cs|php|swift)$",
    r"_spec\.rb$", r"(?i)/spec/.*\.rb$", r"_tests\.(c|cpp|cc)$", r"Test\.(cpp|cc)$", r"(^|/)(Test[^/]*|[^/]*(Tests?|Spec|Suite))\.scala$",
)
TEST_SYMBOL = r"^(test_|it_|Test|Benchmark|Example)|^(describe|it|test|TEST|TEST_F|TEST_P|TEST_CASE|SCENARIO)$"
PUBLIC = r"^[^_]"
RULES = (
    {"type": "HttpRoute", "lang": JS, "low": r"(^|/)app/(.*/)?route\.[^/]*$", "exports": r"(?i)^(" + VERBS + "|all)$"},
    {"type": "HttpRoute", "lang": JS, "low": r"(^|/)pages/(?!(.*/)?api/)(.*/)?[^_/][^/]*$", "default_export": True},
    {"type": "HttpRoute", "lang": JS, "calls": r"^(app|router|server)\.(" + VERBS + "|all)$"},
    {"type": "HttpRoute", "lang": PY, "calls": r"^((app|router)\.(route|get|post|put|delete|patch)|api_view)$", "owner_only": True},
    {"type": "HttpRoute", "lang": PY, "path": r"/(views|routes|endpoints)/|(views|routes|endpoints)\.py$", "needs": WEB["Python"], "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Go",), "needs": WEB["Go"],
        "calls": r"(?i)\.(get|post|put|delete|patch|options|head|any|group)$|\.(HandleFunc|Handle)$|^http\.ListenAndServe$"},
    {"type": "HttpRoute", "lang": ("Go",), "needs": WEB["Go"], "path": r"/handler|/routes/|/api/", "functions": r"^[A-Z].*Handler|^[A-Z].*Handle$|^Handle"},
    {"type": "HttpRoute", "lang": ("Rust",), "needs": r"^(actix_web|actix-web|axum|rocket|warp|hyper|tower)",
        "calls": r"Router::new|\.route|routing::(get|post|put|delete)|^(get|post|put|delete)$|web::(resource|scope)|App::new|\.service|HttpServer::new|routes!|\.mount|rocket::build"},
    {"type": "HttpRoute", "lang": ("Rust",), "needs": r"^(actix_web|actix-web|axum|rocket|warp|hyper|tower)", "path": r"/handler|/routes/|/api/", "functions": ""},
    {"type": "HttpRoute", "lang": ("Java",), "needs": r"^org\.springframework\.(web|boot|stereotype)",
        "named": r"Mapping$|^(RestController|Controller)$", "functions": r"^(?!<init>)"},
    {"type": "HttpRoute", "lang": ("Java",), "needs": r"^(jakarta|javax)\.ws\.rs", "named": r"^(Path|GET|POST|PUT|DELETE)$", "functions": ""},
    {"type": "HttpRoute", "lang": ("Java",), "needs": r"^(jakarta|javax)\.servlet", "functions": r"^do(Get|Post|Put|Delete|Head|Options)$"},
    {"type": "HttpRoute", "lang": ("Java",), "needs": r"^(jakarta|javax)\.servlet",
        "unless": r"^org\.springframework\.(web|boot|stereotype)|^(jakarta|javax)\.ws\.rs", "path": r"/controller|/(resources?|endpoints?|api)/", "functions": ""},
    {"type": "HttpRoute", "lang": ("CSharp",), "unless": r"^(Microsoft\.AspNet|System\.Web)",
        "path": r"/([Cc]ontrollers|[Ee]ndpoints|[Aa]pi)/|Controller\.cs$", "functions": ""},
    {"type": "HttpRoute", "lang": ("CSharp",), "needs": r"^Microsoft\.AspNetCore\.(Mvc|Http|Routing)", "functions": "", "not_stem": True},
    {"type": "HttpRoute", "lang": ("CSharp",), "needs": r"^(Microsoft\.AspNet|System\.Web)", "calls": r"(^|\.)Map(Get|Post|Put|Delete|Patch)$"},
    {"type": "HttpRoute", "lang": ("Php",), "unless": r"^(Illuminate|Laravel|Symfony)\\",
        "path": r"/([Cc]ontrollers|[Rr]outes|[Aa]pi)/|Controller\.php$", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Php",), "needs": r"^(Illuminate|Laravel|Symfony)\\", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Ruby",), "needs": r"^(sinatra|sinatra/base|grape)$", "calls": f"^({VERBS})$", "by_callee": True},
    {"type": "HttpRoute", "lang": ("Ruby",), "unless": r"^(sinatra|sinatra/base|grape)$", "needs": r"^(action_controller|rails|active_record)$",
        "functions": r"^(?!_|initialize$)"},
    {"type": "HttpRoute", "lang": ("Ruby",), "unless": r"^(sinatra|sinatra/base|grape|action_controller|rails|active_record)$",
        "path": r"/([Cc]ontrollers|routes)/|_controller\.rb$", "functions": r"^(?!_|initialize$)"},
    {"type": "HttpRoute", "lang": ("Kotlin",), "needs": r"^io\.ktor", "calls": f"^({VERBS}|route)$", "by_callee": True},
    {"type": "HttpRoute", "lang": ("Kotlin",), "unless": r"^io\.ktor", "needs": r"^org\.springframework", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Kotlin",), "unless": r"^(io\.ktor|org\.springframework)", "path": r"/(controllers?|routes)/|Controller\.kt$", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Swift",), "needs": r"^Vapor$", "calls": f"^({VERBS}|route)$", "by_callee": True},
    {"type": "HttpRoute", "lang": ("Swift",), "unless": r"^Vapor$", "path": r"/([Cc]ontrollers|[Rr]outes)/|Controller\.swift$", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("C", "Cpp"), "needs": r"crow|httplib|pistache|drogon|cpprest|beast|mongoose",
        "calls": f"(?i)^({VERBS})$|route|handler", "by_callee": True},
    {"type": "HttpRoute", "lang": ("C", "Cpp"), "unless": r"crow|httplib|pistache|drogon|cpprest|beast|mongoose",
        "path": r"/(handlers|controllers|routes|endpoints)/", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Scala",), "needs": r"^akka\.http", "calls": f"^({VERBS}|path|pathPrefix|complete)$", "by_callee": True},
    {"type": "HttpRoute", "lang": ("Scala",), "unless": r"^akka\.http", "needs": r"^play\.(api\.)?mvc", "functions": PUBLIC},
    {"type": "HttpRoute", "lang": ("Scala",), "unless": r"^(akka\.http|play\.(api\.)?mvc)", "needs": r"^org\.http4s",
        "calls": r"(?i)^(get|post|put|delete|patch)$", "by_callee": True},
    {"type": "HttpRoute", "lang": ("Scala",), "unless": r"^(akka\.http|play\.(api\.)?mvc|org\.http4s)",
        "path": r"/(controllers?|routes)/|Controller\.scala$", "functions": PUBLIC},
    {"type": "HttpRoute", "low": STRONG_ROUTE_PATH, "functions": PUBLIC, "exports": ""},
    {"type": "HttpRoute", "low": ROUTE_PATH, "framework": WEB, "functions": PUBLIC, "exports": ""},
    {"type": "HttpRoute", "lang": ("Python", "Ruby", "Php"), "low": r"/views/", "framework": WEB, "functions": PUBLIC},
    {"type": "CliCommand", "lang": MAIN_LANGUAGES, "functions": r"^main$"},
    {"type": "CliCommand", "path": r"/(cli|cmd|bin)/|/(main\.(ts|js|go)|cli\.(ts|js|py))$", "functions": r"^main$"},
    {"type": "CliCommand", "lang": PY, "needs": r"^(argparse|click|typer)$", "calls": r"^(click\.(command|group)|app\.command|typer\.command)$", "owner_only": True},
    {"type": "CliCommand", "lang": ("Go",), "needs": r"^github\.com/spf13/cobra", "calls": r"cobra\.Command|AddCommand", "owner_only": True},
    {"type": "CliCommand", "lang": ("Rust",), "needs": r"^clap", "calls": r"Command::new|Parser::parse", "owner_only": True},
    {"type": "CliCommand", "lang": JS, "needs": r"^(commander|yargs|meow|cac)$", "file": True},
    {"type": "CliCommand", "path": r"(^|/)bin/", "file": True, "without_main": True},
    {"type": "CliCommand", "low": CLI_PATH, "framework": CLI, "functions": PUBLIC, "exports": ""},
    {"type": "CliCommand", "low": r"/commands?/", "functions": PUBLIC, "exports": ""},
    {"type": "QueueConsumer", "needs": r"^(amqplib|bull|bullmq|bee-queue|sqs-consumer|kafkajs|celery|kombu|pika|aio_pika|rq)(/.*)?$",
        "calls": r"(?i)subscribe|consume|onmessage|on_message|process|handle_message|handlemessage"},
    {"type": "QueueConsumer", "needs": r"^(amqplib|bull|bullmq|bee-queue|sqs-consumer|kafkajs|celery|kombu|pika|aio_pika|rq)(/.*)?$",
        "path": r"/(workers|jobs|consumers|tasks)/|(_worker\.(py|ts|js)|Worker\.(ts|js))$", "functions": r"process|handle|consume|^(run|execute)$"},
    {"type": "CronJob", "needs": r"^(node-cron|cron|node-schedule|agenda|apscheduler|schedule|celery)(\..*)?$", "calls": r"schedule|cron|every|interval|addJob|add_job"},
    {"type": "CronJob", "path": r"/(cron|scheduler|scheduled)/|_(cron|scheduler)\.py$", "calls": r"schedule|cron|every|interval|addJob|add_job"},
    {"type": "ReactPage", "lang": JS, "low": r"(^|/)page\.[^/]*$|(^|/)pages/(?!(.*/)?api/)(.*/)?[^_/][^/]*$",
        "not_low": r"(^|/)app/(.*/)?route\.[^/]*$", "default_export": True},
    {"type": "EventHandler", "needs": r"^(events|eventemitter3|mitt|rxjs|socket\.io|ws)(/.*)?$", "calls": r"\.(addEventListener|on|addListener|once|subscribe)$"},
    {"type": "HttpRoute", "lang": JS, "needs": r"^(@effect/platform|effect)", "calls": r"^HttpRouter\.(get|post|put|delete|patch)$|^HttpApi\w*\.\w+$"},
    {"type": "CliCommand", "lang": JS, "needs": r"^@effect/cli", "calls": r"^Command\.(make|run)$"},
    {"type": "QueueConsumer", "lang": JS, "needs": r"^effect/(Queue|PubSub)$",
        "calls": r"^(Queue\.(take|poll|dequeue|takeBetween|takeAll|takeUpTo)|PubSub\.(subscribe|subscribeScopedWith))$"},
    {"type": "QueueConsumer", "lang": JS, "needs": r"^effect$", "named": r"^(Queue|PubSub)$",
        "calls": r"^(Queue\.(take|poll|dequeue|takeBetween|takeAll|takeUpTo)|PubSub\.(subscribe|subscribeScopedWith))$"},
    {"type": "CronJob", "lang": JS, "needs": r"^(@effect/cron(/.*)?|effect/Schedule)$",
        "calls": r"^(Schedule\.(cron|fixed|spaced|recurring|forever|once|dayOfWeek|hourOfDay)|Cron\.(make|parse|match))$"},
    {"type": "CronJob", "lang": JS, "needs": r"^effect$", "named": r"^Schedule$",
        "calls": r"^(Schedule\.(cron|fixed|spaced|recurring|forever|once|dayOfWeek|hourOfDay)|Cron\.(make|parse|match))$"},
    {"type": "TestFile", "lang": JS, "needs": r"^@effect/vitest(/.*)?$", "calls": r"^it\.(effect|scoped|live|flakyTest)$"},
    {"type": "EventHandler", "lang": JS, "needs": r"^effect/(Stream|Hub)$", "calls": r"^(Stream\.run(|ForEach|Collect|Drain|Fold|Scoped)|Hub\.(subscribe|publishAll))$"},
    {"type": "EventHandler", "lang": JS, "needs": r"^effect$", "named": r"^(Stream|Hub)$",
        "calls": r"^(Stream\.run(|ForEach|Collect|Drain|Fold|Scoped)|Hub\.(subscribe|publishAll))$"},
    {"type": "EffectService", "lang": JS, "needs": r"^(effect|@effect/)", "calls": r"^(Context\.Tag|Context\.GenericTag|Effect\.Service|Layer\.\w+)$"},
    {"type": "CliCommand", "lang": ("Rust",), "low": r"/(modules|commands|plugins|handlers|subcommands|cmds|configs)/", "not_low": r"/mod\.rs$", "file": True},
    {"type": "CliCommand", "lang": ("Rust",), "low": r"(^|/)(main|lib)\.rs$", "file": True, "with_definitions": True},
)
# --- end of fixed values ----------------------------------------------------------


def is_test_path(path: str = "path") -> Column:
    out = F.lit(False)
    for p in TEST_PATH:
        out = out | F.col(path).rlike(p)
    return out


def _symbols(ord_: int, rule: dict) -> Column:
    """The rule's symbols for a file as an array of structs, empty where it does not apply."""
    ok = F.lit(True)
    if "lang" in rule:
        ok = ok & F.col("language").isin(*rule["lang"])
    for key, column in (("path", F.col("path")), ("low", F.lower("path"))):
        if key in rule:
            ok = ok & column.rlike(rule[key])
    if "not_low" in rule:
        ok = ok & ~F.lower("path").rlike(rule["not_low"])
    has = lambda pattern: F.exists("imports", lambda i: i.source.rlike(pattern))
    if "needs" in rule:
        ok = ok & has(rule["needs"])
    if "unless" in rule:
        ok = ok & ~has(rule["unless"])
    if "named" in rule:
        ok = ok & F.exists("imports", lambda i: F.exists(i.names, lambda n: n["name"].rlike(rule["named"])) | F.regexp_extract(i.source, r"(\w+)$",
            1).rlike(rule["named"]))
    if "framework" in rule:
        some = F.lit(False)
        for lang, pattern in rule["framework"].items():
            some = some | ((F.col("language") == lang) & has(pattern))
        ok = ok & some
    if rule.get("without_main"):
        ok = ok & ~F.exists("definitions", lambda d: d["name"] == "main")
    if rule.get("with_definitions"):
        ok = ok & (F.size("definitions") > 0)
    parts = []
    if "calls" in rule:
        hit = F.filter("call_sites", lambda c: c.callee.rlike(rule["calls"]))
        if rule.get("owner_only"):
            hit = F.filter(hit, lambda c: c.containing_function.isNotNull())
        parts.append(F.transform(hit, lambda c: c.callee if rule.get("by_callee") else F.coalesce(c.containing_function, c.callee)))
    if "functions" in rule:
        hit = F.filter("definitions", lambda d: (d.kind == "Function") & d["name"].rlike(rule["functions"]))
        names = F.transform(hit, lambda d: d["name"])
        parts.append(F.filter(names, lambda n: n != F.regexp_replace(paths.file_name("path"), r"\.cs$", "")) if rule.get("not_stem") else names)
    if "exports" in rule:
        own = F.transform(F.filter("exports", lambda e: e["name"].rlike(rule["exports"])), lambda e: e["name"])
        parts.append(own if "lang" in rule else F.when(F.col("language").isin(*JS), own).otherwise(F.array().cast("array<string>")))
    if rule.get("default_export"):
        parts.append(F.slice(F.transform(F.filter("exports", lambda e: e.is_default), lambda e: e["name"]), 1, 1))
    if rule.get("file"):
        parts.append(F.array(paths.file_stem("path")))
    found = F.transform(F.concat(*parts), lambda s: F.struct(s.alias("symbol"), F.lit(ord_).alias("ord"), F.lit(rule["type"]).alias("entrypoint_type")))
    return F.when(ok, found).otherwise(F.array().cast("array<struct<symbol:string,ord:int,entrypoint_type:string>>"))


def detect(parsed: DataFrame) -> DataFrame:
    """Parsed files -> ``(file, symbol, entrypoint_type)``, one row a symbol, the earliest rule's type."""
    names = F.transform(F.filter("definitions", lambda d: d["name"].rlike(TEST_SYMBOL)), lambda d: d["name"])
    tests = F.when(is_test_path(), F.transform(F.when(F.size(names) > 0, names).otherwise(F.array(paths.file_stem("path"))),
        lambda s: F.struct(s.alias("symbol"), F.lit(0).alias("ord"), F.lit("TestFile").alias("entrypoint_type")))).otherwise(
        F.array().cast("array<struct<symbol:string,ord:int,entrypoint_type:string>>"))
    out = None
    # a few rules to a projection, so that generated code stays small
    rules = list(enumerate(RULES, 1))
    for i in range(0, len(rules), 9):
        found = parsed.select(F.col("path").alias("file"), F.inline(F.concat(*([tests] if i == 0 else []), *[_symbols(n, r) for n, r in rules[i:i + 9]])))
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("ord", "entrypoint_type")).alias("b")
    return out.where("symbol is not null").groupBy("file", "symbol").agg(best).select("file", "symbol", "b.entrypoint_type")
