"""straitline: supply-network risk analytics as PySpark DataFrame operators."""

from straitline.session import checkpointed, get_session

__all__ = ["checkpointed", "get_session"]
