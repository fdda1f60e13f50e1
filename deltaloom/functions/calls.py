"""Call sites by what they do: logging, configuration, HTTP, events, storage."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import _c

# --- fixed values -----------------------------------------------------------------
LOG_CALLS = (
    "console.log", "console.error", "console.warn", "console.info", "console.debug", "console.trace", "logger.info", "logger.error", "logger.warn",
        "logger.debug", "logger.trace", "logger.fatal",
    "logging.info", "logging.error", "logging.warning", "logging.debug", "logging.critical", "log.info", "log.error", "log.warn", "log.debug",
)
CONFIG_ANY_SUFFIX = ("process.env", "os.environ")
CONFIG_CALLS = ("process.env", "os.environ", "os.getenv", "config.get", "config.set", "dotenv", "Deno.env")
HTTP_CALLS = (
    "fetch", "axios.get", "axios.post", "axios.put", "axios.delete", "axios.patch", "axios.request", "requests.get", "requests.post", "requests.put",
        "requests.delete", "requests.patch",
    "http.get", "http.post", "http.request", "urllib.request", "httpx.get", "httpx.post",
)
COLLECTION_METHODS = (
    "push", "pop", "shift", "unshift", "splice", "slice", "concat", "join", "reverse", "sort", "fill", "copyWithin", "flat", "flatMap", "map",
        "filter", "reduce", "forEach", "some", "every",
    "includes", "indexOf", "find", "findIndex", "append", "extend", "clear", "copy", "items", "len", "keys", "values", "entries", "toString",
        "toLocaleString", "has", "add",
    "parse", "stringify", "assign", "from", "resolve", "reject", "now", "round", "floor", "ceil", "abs", "min", "max", "charAt", "charCodeAt", "trim",
        "split", "replace", "match",
    "startsWith", "endsWith", "padStart", "padEnd", "repeat", "toLowerCase", "toUpperCase",
)
PLAIN_CALLS = (
    "JSON.parse", "JSON.stringify", "Object.create", "Object.assign", "Array.from", "Promise.resolve", "Promise.reject", "Date.now", "Math.round",
        "Math.floor", "Math.ceil", "Math.abs", "Math.min", "Math.max",
)
EMIT_METHODS = ("emit", "publish", "send", "dispatch", "fire", "trigger", "broadcast", "notify", "produce", "enqueue")
HANDLE_METHODS = ("on", "subscribe", "listen", "addEventListener", "addListener", "handle", "consume", "onMessage", "onEvent")
WRITE_METHODS = (
    "save", "insert", "create", "update", "delete", "remove", "upsert", "bulkCreate", "bulkInsert", "insertMany", "updateMany", "deleteMany",
        "findAndUpdate", "findOneAndUpdate",
    "findOneAndDelete", "findOneAndRemove", "persist", "flush", "execute", "run",
)
READ_METHODS = ("find", "findOne", "findById", "findAll", "findMany", "findFirst", "findUnique", "query", "select", "get", "fetch", "count",
    "aggregate", "groupBy", "where")
SQL_WRITES = ("insert into", "update ", "delete from", "drop table", "alter table", "create table", "truncate")
SQL_READS = ("select ", "select\n")
PLAIN_RECEIVERS = (
    "array", "map", "set", "object", "string", "number", "promise", "json", "math", "date", "regexp", "cache", "localstorage", "sessionstorage",
        "window", "document", "navigator", "console",
    "process", "os", "path", "fs", "http", "https", "url", "buffer", "stream", "crypto", "util", "events", "child_process", "cluster", "net", "tls",
        "dns", "axios", "requests", "fetch", "httpx",
    "urllib", "list", "dict", "tuple", "frozenset", "deque", "defaultdict", "items", "result", "results", "data", "response", "request", "config",
        "env", "settings", "options", "args", "params",
    "logger", "log", "logging",
)
STORE_WORDS = (
    "db", "database", "repo", "repository", "model", "store", "dao", "collection", "prisma", "sequelize", "typeorm", "mongoose", "drizzle", "session",
        "connection", "pool", "client", "table",
    "entity", "schema", "migration", "knex", "query", "sql",
)
#: pattern -> edge type; logging gives no edge
EDGE_OF_PATTERN = {
    "Persistence": "Writes", "DatabaseRead": "Reads", "EventEmission": "Emits", "EventHandling": "Handles", "ConfigRead": "Reads", "HttpCall": "Reads",
}
# --- end of fixed values ----------------------------------------------------------


def _has(text: Column, words) -> Column:
    """Whether the text contains one of the words; one regular expression keeps the generated code small."""
    return text.rlike("|".join(re.escape(w) for w in words))


def _starts(text: Column, words, ends: str = "") -> Column:
    """The text starts with one of the words; with ``ends``, it is that word or goes on with one of these characters."""
    return text.rlike("^(?:" + "|".join(re.escape(w) for w in words) + ")" + (f"(?:$|[{re.escape(ends)}])" if ends else ""))


def stores(callee) -> Column:
    """Whether what stands before the last dot looks like a data store."""
    receiver = F.lower(F.regexp_extract(_c(callee), r"(?s)^(.*)\.[^.]*$", 1))
    return (F.length(receiver) > 1) & ~receiver.isin(*PLAIN_RECEIVERS) & _has(receiver, STORE_WORDS)


def pattern(callee) -> Column:
    """The first pattern that the call meets, null for none."""
    c = _c(callee)
    low, method, dotted = F.lower(c), F.substring_index(c, ".", -1), F.contains(c, F.lit("."))
    config = _starts(c, CONFIG_ANY_SUFFIX) | _starts(c, CONFIG_CALLS, ".[")
    plain = method.isin(*COLLECTION_METHODS) | c.isin(*PLAIN_CALLS)
    writes = (dotted & method.isin(*WRITE_METHODS) & stores(c)) | _has(low, SQL_WRITES)
    reads = (dotted & method.isin(*READ_METHODS) & stores(c)) | _has(low, SQL_READS)
    return (
        F.when(c.isin(*LOG_CALLS), "Logging").when(config, "ConfigRead").when(_starts(c, HTTP_CALLS, "."), "HttpCall").when(plain, None)
        .when(dotted & method.isin(*EMIT_METHODS), "EventEmission").when(dotted & method.isin(*HANDLE_METHODS), "EventHandling")
        .when(writes, "Persistence").when(reads, "DatabaseRead")
    )


# fixed values: words of mappers, and of receivers that are stores
MAPPERS = ("prisma", "sequelize", "typeorm", "mongoose", "sqlalchemy", "drizzle")
STORE_RECEIVERS = ("db", "repo", "model", "store", "dao", "collection")


def confidence(callee) -> Column:
    """How sure it is that a call that looks like a store's is one: a mapper's, a store's by its first name, a statement's, or some method's."""
    low = F.lower(_c(callee))
    first = F.lower(F.substring_index(_c(callee), ".", 1))
    return F.when(_has(low, MAPPERS), 0.95).when(_has(first, STORE_RECEIVERS), 0.9).when(_has(low, (*SQL_WRITES, *SQL_READS)), 0.95).otherwise(0.7)


def edge_type(pattern_column) -> Column:
    pairs = [F.lit(x) for kv in EDGE_OF_PATTERN.items() for x in kv]
    return F.element_at(F.create_map(*pairs), _c(pattern_column))


def frameworks(imports, dictionary):
    """``imports(target, source)``, ``dictionary(pattern, name)`` -> distinct ``(target, name)``.

    A pattern is the whole source, or goes before one of ``/ . : \\`` in it. The
    source's prefixes at those places are exploded and met by equality.
    """
    cuts = F.filter(F.sequence(F.lit(1), F.length("source")), lambda i: F.substr("source", i, F.lit(1)).isin("/", ".", ":", "\\"))
    heads = F.concat(F.array("source"), F.transform(cuts, lambda i: F.substr("source", F.lit(1), i - 1)))
    spread = imports.where("source <> ''").select("target", F.explode(F.array_distinct(heads)).alias("pattern"))
    return spread.join(dictionary.select("pattern", "name"), "pattern").select("target", "name").distinct()


# fixed values: frameworks and the import sources that show them. An analysis may be given a longer table instead.
_FRAMEWORKS = {
    "Express": ("express",), "Fastify": ("fastify",), "Next.js": ("next",), "React": ("react", "react-dom"), "Vue": ("vue",),
        "Angular": ("@angular/core",), "Svelte": ("svelte",),
    "NestJS": ("@nestjs/common", "@nestjs/core"), "Hono": ("hono",), "Koa": ("koa",), "Effect.ts": ("@effect", "effect"),
        "Prisma": ("prisma", "@prisma/client"), "TypeORM": ("typeorm",),
    "Sequelize": ("sequelize",), "Mongoose": ("mongoose",), "Drizzle": ("drizzle-orm",), "tRPC": ("@trpc/server", "@trpc/client"), "GraphQL": ("graphql",),
    "Apollo": ("@apollo/server", "@apollo/client"), "Tailwind CSS": ("tailwindcss",), "Redux": ("redux", "@reduxjs/toolkit"), "Zustand": ("zustand",),
        "Zod": ("zod",), "Vitest": ("vitest",), "Jest": ("jest",),
    "FastAPI": ("fastapi",), "Flask": ("flask",), "Django": ("django",), "SQLAlchemy": ("sqlalchemy",), "Pydantic": ("pydantic",),
        "Celery": ("celery",), "pytest": ("pytest",), "Alembic": ("alembic",),
    "Tortoise ORM": ("tortoise",), "Starlette": ("starlette",), "aiohttp": ("aiohttp",), "httpx": ("httpx",), "Uvicorn": ("uvicorn",),
    "Go net/http": ("net/http",), "Gin": ("github.com/gin-gonic/gin",), "Echo": ("github.com/labstack/echo",), "Chi": ("github.com/go-chi/chi",),
        "Fiber": ("github.com/gofiber/fiber",),
    "Gorilla Mux": ("github.com/gorilla/mux",), "gRPC": ("google.golang.org/grpc",), "Cobra": ("github.com/spf13/cobra",),
        "Viper": ("github.com/spf13/viper",), "GORM": ("gorm.io/gorm",),
    "Go database/sql": ("database/sql",), "Testify": ("github.com/stretchr/testify",),
    "Actix-web": ("actix_web", "actix-web"), "Axum": ("axum",), "Rocket": ("rocket",), "Warp": ("warp",), "Hyper": ("hyper",), "Tokio": ("tokio",),
        "Diesel": ("diesel",), "SQLx": ("sqlx",),
    "SeaORM": ("sea_orm", "sea-orm"), "Clap": ("clap",), "Tauri": ("tauri",), "Serde": ("serde",), "Tower": ("tower",), "Tonic": ("tonic",), "Tracing": ("tracing",),
    "Spring Boot": ("org.springframework.boot", "org.springframework.stereotype", "org.springframework.beans", "org.springframework.context"),
        "Spring MVC": ("org.springframework.web",),
    "Spring Data": ("org.springframework.data",), "Spring Security": ("org.springframework.security",),
        "JPA": ("jakarta.persistence", "javax.persistence"), "JAX-RS": ("jakarta.ws.rs", "javax.ws.rs"),
    "Servlet": ("jakarta.servlet", "javax.servlet"), "Hibernate": ("org.hibernate",), "JUnit": ("org.junit",), "Mockito": ("org.mockito",),
        "Micronaut": ("io.micronaut",), "Quarkus": ("io.quarkus",),
    "ASP.NET Core": ("Microsoft.AspNetCore",), "ASP.NET Core MVC": ("Microsoft.AspNetCore.Mvc",),
        "Entity Framework Core": ("Microsoft.EntityFrameworkCore",), "xUnit": ("Xunit",), "MediatR": ("MediatR",), "Dapper": ("Dapper",),
    "Laravel": ("Illuminate", "Laravel"), "Symfony": ("Symfony",), "Doctrine ORM": ("Doctrine\\ORM",), "Guzzle": ("GuzzleHttp",), "PHPUnit": ("PHPUnit",),
    "Rails": ("rails", "action_controller", "active_support", "action_view", "action_mailer"), "Rails ActiveRecord": ("active_record",),
        "Sinatra": ("sinatra",), "Rack": ("rack",), "Grape": ("grape",),
    "Hanami": ("hanami",), "RSpec": ("rspec",), "Sidekiq": ("sidekiq",), "Roda": ("roda",),
    "Ktor": ("io.ktor",), "Exposed": ("org.jetbrains.exposed",), "Kotlin Coroutines": ("kotlinx.coroutines",), "Vapor": ("Vapor",),
        "SwiftUI": ("SwiftUI",), "UIKit": ("UIKit",), "XCTest": ("XCTest",),
    "Play Framework": ("play.api.mvc", "play.mvc"), "Akka": ("akka.actor",), "Akka HTTP": ("akka.http",), "ScalaTest": ("org.scalatest",),
        "http4s": ("org.http4s",), "Cats": ("cats",), "ZIO": ("zio",),
}
FRAMEWORKS = [(pattern, name) for name, patterns in _FRAMEWORKS.items() for pattern in patterns]
