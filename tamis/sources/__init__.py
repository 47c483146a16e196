"""Reading landed feeds: JSON, RSS, HTML; and the writers."""
