"""Label rules R1 to R5 and the bot score, as column expressions with the thresholds as parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import per


def session_actor(
    commands: Column, sessions: Column, downloads: Column, mean_duration: Column, success_rate: Column,
    *, min_commands: float = 1, long_session: float = 10, high_success: float = 0.5, needed: int = 2,
) -> Column:
    """R1: Manual when at least ``needed`` of four signs of a person hold, else Bot."""
    signs = (
        per(commands, sessions) >= min_commands,
        downloads > 0,
        mean_duration > long_session,
        success_rate > high_success,
    )
    score = sum((F.when(sign, 1).otherwise(0) for sign in signs), F.lit(0))
    return F.when(score >= needed, "Manual").otherwise("Bot")


def flow_actor(
    mean_duration: Column, protocols: Column, *, short_flow: float = 0.5, few_protocols: int = 1
) -> Column:
    """R2: short flows over one protocol are a Bot, all else Manual."""
    bot = (mean_duration < short_flow) & (protocols <= few_protocols)
    return F.when(bot, "Bot").otherwise("Manual")


def _exploited(commands: Column, downloads: Column, successes: Column) -> Column:
    return ((commands > 0) | (downloads > 0)) & (successes > 0)


def threat_level(
    commands: Column, downloads: Column, successes: Column, logins: Column, mean_duration: Column,
    *, many_logins: int = 50, long_session: float = 5,
) -> Column:
    """R3: threat from the full history."""
    entered = (successes > 0) & (commands == 0)
    persistent = (logins > many_logins) & (mean_duration > long_session)
    return (
        F.when(_exploited(commands, downloads, successes), "High")
        .when(entered | persistent, "Medium")
        .otherwise("Low")
    )


def flow_behaviour(
    ports: Column, flows: Column, *, scan_ports: int = 20, heavy: int = 500, few_ports: int = 5, some: int = 10
) -> Column:
    """R4: scanning behaviour from the full history."""
    return (
        F.when((ports > scan_ports) & (flows > heavy), "Aggressive")
        .when(ports > scan_ports, "Recon")
        .when((ports <= few_ports) & (flows > some), "Targeted")
        .otherwise("Recon")
    )


def window_threat(commands: Column, downloads: Column, successes: Column) -> Column:
    """R5: the threat rule of the detection-window study."""
    return (
        F.when(_exploited(commands, downloads, successes), "High")
        .when(successes > 0, "Medium")
        .otherwise("Low")
    )


def bot_score(columns: list[str] | None = None) -> Column:
    """Sum of six bot indicators over a feature row; indicators whose column is absent add nothing."""
    c = F.col
    indicators = {
        "total_attempts": lambda: F.log1p(c("total_attempts")) / 10,
        "avg_time_between": lambda: 1 / (1 + c("avg_time_between") / 10),
        "password_reuse_ratio": lambda: F.least(c("password_reuse_ratio"), F.lit(100)) / 100,
        "avg_password_entropy": lambda: F.greatest(F.lit(0.0), 3 - c("avg_password_entropy")) / 3,
        "hour_entropy": lambda: c("hour_entropy") / 4,
        "commands_per_session": lambda: 1 / (1 + c("commands_per_session")),
    }
    used = [build() for name, build in indicators.items() if columns is None or name in columns]
    return sum(used, F.lit(0.0))
