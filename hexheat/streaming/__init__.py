"""The parts of the film that can run as data arrives."""
