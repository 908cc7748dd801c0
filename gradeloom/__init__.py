"""Spark-native data work for rollout training runs: curation, grading,
group-relative advantages, reward trees, batch shaping and run statistics."""
