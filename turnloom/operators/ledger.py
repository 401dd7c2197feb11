"""Model requests: plans with reserved cost, an append-only ledger, snapshots, and
a runner that never repeats a request whose outcome is unknown. The network stays
with the caller: ``send`` is any function of a request."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.spec import ContractError, money, require

MONEY = "decimal(38,12)"
ATTEMPT = f"request_hash string, attempt int, status string, charge {MONEY}, reserved {MONEY}, input_tokens long, output_tokens long, error_code string, label int"
#: Outcomes after which a request must not be sent again by itself.
UNRESOLVED = ("submitted_unknown", "usage_unverified")


def charge(input_tokens: Column, output_tokens: Column, in_price, out_price) -> Column:
    """Cost at prices for a million tokens."""
    million = F.lit(Decimal(10**6)).cast("decimal(10,0)")
    part = lambda n, p: n.cast("decimal(18,0)") * F.lit(money(p)).cast("decimal(12,6)") / million
    return (part(input_tokens, in_price) + part(output_tokens, out_price)).cast(MONEY)


def plan(rows: DataFrame, body: str, in_price, out_price, max_output: int, overhead: int = 0) -> DataFrame:
    """Requests with their hash and the most they can cost: a token is one byte at
    least."""
    size = (F.octet_length(F.col(body)) + overhead).cast("long")
    return rows.withColumn("request_hash", F.sha2(F.col(body), 256)).withColumn("reserved", charge(size, F.lit(max_output), in_price, out_price))


def spend(attempts: DataFrame, prior="0") -> DataFrame:
    """Charged so far; an attempt of unknown outcome counts with its reserve."""
    used = F.when(F.col("status").isin(*UNRESOLVED), F.coalesce("charge", "reserved")).otherwise(F.coalesce("charge", F.lit(0)))
    return attempts.agg((F.lit(money(prior)).cast(MONEY) + F.coalesce(F.sum(used), F.lit(0))).cast(MONEY).alias("spent"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def snapshot(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Latest state of each request: the first validated attempt, else the last one."""
    w = Window.partitionBy("request_hash")
    good = F.min(F.when(F.col("status") == "validated", F.col("attempt"))).over(w)
    chosen = attempts.withColumn("pick", F.coalesce(good, F.max("attempt").over(w))).where("attempt = pick").drop("pick")
    return requests.join(chosen, "request_hash", "left").withColumn("status", F.coalesce("status", F.lit("not_attempted")))


def run(requests: list[dict], attempts: list[dict], send: Callable[[dict], dict], budget, price: tuple, *, execute: bool = False, max_attempts: int = 1, retry_invalid: bool = False, save: Callable[[list[dict]], None] = lambda _: None) -> list[dict]:
    """Driver loop: reserve, record, send, settle. ``send`` returns input_tokens,
    output_tokens and label; it raises ContractError for an invalid answer and
    anything else for an unknown outcome. Only an invalid answer may be tried again."""
    log = [dict(a) for a in attempts]
    if not execute:
        return log
    require(not any(a["status"] in UNRESOLVED for a in log), "UNRESOLVED_CHARGE")
    cost = lambda i, o: (money(price[0]) * i + money(price[1]) * o) / 10**6
    for r in requests:
        own = [a for a in log if a["request_hash"] == r["request_hash"]]
        while not any(a["status"] == "validated" for a in own) and (not own or (retry_invalid and len(own) < max_attempts)):
            if sum((money(a["charge"] or 0) for a in log), Decimal(0)) + money(r["reserved"]) > money(budget):
                log.append({"request_hash": r["request_hash"], "attempt": len(own) + 1, "status": "budget_exhausted", "charge": Decimal(0), "reserved": money(r["reserved"]), "input_tokens": None, "output_tokens": None, "error_code": None, "label": None})
                save(log)
                return log
            a = {"request_hash": r["request_hash"], "attempt": len(own) + 1, "status": "submitted_unknown", "charge": money(r["reserved"]), "reserved": money(r["reserved"]), "input_tokens": None, "output_tokens": None, "error_code": None, "label": None}
            log.append(a)
            save(log)  # before anything is sent
            try:
                out = send(r)
            except ContractError as e:
                usage = getattr(e, "usage", None)
                a |= {"status": "validation_failed" if usage else "usage_unverified", "error_code": str(e)}
                a |= {"input_tokens": usage[0], "output_tokens": usage[1], "charge": cost(*usage)} if usage else {}
            except Exception as e:  # noqa: BLE001  the request may have been delivered
                a["error_code"] = type(e).__name__
                save(log)
                return log
            else:
                a |= {"status": "validated", "input_tokens": out["input_tokens"], "output_tokens": out["output_tokens"], "charge": cost(out["input_tokens"], out["output_tokens"]), "label": out.get("label")}
            own.append(a)
            save(log)
            if a["status"] in UNRESOLVED:
                return log
    return log
