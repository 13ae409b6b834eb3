"""voxlake: transcript and speech-corpus analytics as Spark DataFrame jobs."""
