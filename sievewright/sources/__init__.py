"""Where tables come from: checkouts, paged services, event files, the environment."""
