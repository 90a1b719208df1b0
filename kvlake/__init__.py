"""kvlake: a Spark-native engine for versioned key-value data."""
from kvlake.plans.store import KVStore
from kvlake.schema import MUTATION, mutation_log

__all__ = ["KVStore", "MUTATION", "mutation_log"]
