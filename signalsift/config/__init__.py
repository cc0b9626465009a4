from signalsift.config import telemetry

__all__ = ["telemetry"]
