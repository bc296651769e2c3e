"""Settings of detection and alerting, with their default values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    window_ms: int = 60_000
    burst_requests: int = 20
    burst_points: int = 30
    flood_requests: int = 100
    flood_points: int = 40
    error_count: int = 8
    error_points: int = 25
    path_count: int = 12
    path_points: int = 25
    bonus_per_rule: int = 10
    emit_score: int = 40
    alert_score: int = 70
    alert_cooldown_s: int = 15
    ddos_window_s: int = 10
    ddos_requests: int = 300
    ddos_ips: int = 20
    ddos_cooldown_s: int = 10
    ddos_score: int = 90
    future_skew_s: int = 300
