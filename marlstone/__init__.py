"""marlstone: message-text extraction, evaluation analytics and corpus preparation on Spark."""
