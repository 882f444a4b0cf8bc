"""Track, role, association and play-interval analytics as Spark DataFrame operators."""

from trackloom.settings import AssociationSettings, EvidenceSettings, LinkSettings, RallySettings

__all__ = ["AssociationSettings", "EvidenceSettings", "LinkSettings", "RallySettings"]
